"""Encoding with public tokenizers inside Spark tasks."""

from __future__ import annotations

import functools
import itertools
import os

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: runs encoded at once, and runs of one text
SLICE, JOINED = 4096, 64
#: words by which an encoder tells what its tokenizer does
PROBES = ("a", "Word", "MIXEDcase", "naïve", "x1", "the", "Überraschung", "ÉTÉ", "internationalisation", "ﬁ", "Ñandú", "don't")


def vocabulary_path(name: str) -> str:
    """Where the file of a public tokenizer lies; a path is taken as it is."""
    if os.path.sep in name:
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


class ChunkEncoder:
    """Encodes texts by a tokenizer that drops white space and never joins what white space parts.

    Each distinct run of other characters is encoded once and its ids are kept, up to `keep` runs; then the store starts afresh. Where
    the tokenizer lower-cases, and where it parts letters from punctuation, runs are lower-cased and cut there beforehand, so that fewer
    are distinct. PROBES tell what it does when the encoder is made; one that joins what white space parts encodes whole texts.
    """

    def __init__(self, vocabulary: str, keep: int = 400_000) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark's tasks share the cores already
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(vocabulary_path(vocabulary))
        self.keep = keep
        self.lowers = all(self.ids_of(x) == self.ids_of(x.lower()) for x in PROBES)
        self.cuts = all(self.ids_of(x + sign) == self.ids_of(x) + self.ids_of(sign) for x in PROBES for sign in ".,;:!?")
        self.parts = all(self.ids_of(f"{x} {y}\n\t{x} ") == self.ids_of(x) + self.ids_of(y) + self.ids_of(x) for x in PROBES for y in PROBES)
        self.sign, self.sign_id = self.separator()
        self.clear()

    def separator(self) -> tuple[str, int]:
        """An added token that parts texts wherever it stands, and its id; an empty text if the tokenizer has none.

        No added token may begin within another, so that none is found across the end of a run.
        """
        added = self.tokenizer.get_added_tokens_decoder()
        for number, token in added.items():
            plain = token.special and not (token.normalized or token.lstrip or token.rstrip or token.single_word)
            apart = all(token.content[0] not in x.content[1:] for x in added.values())
            if plain and apart and all(self.ids_of(x + token.content + y) == [*self.ids_of(x), number, *self.ids_of(y)] for x in PROBES for y in PROBES):
                return token.content, number
        return "", -1

    def coded(self, runs: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the runs behind each other, and how many each has. Runs joined by the separator share the cost of an encoding."""
        lone = not self.sign or any(self.sign in x for x in runs)
        texts = runs if lone else [self.sign.join(runs[k : k + JOINED]) for k in range(0, len(runs), JOINED)]
        found = [x.ids for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        lengths = np.fromiter(map(len, found), np.int64, len(found))
        ids = np.fromiter(itertools.chain.from_iterable(found), np.uint32, int(lengths.sum()))
        if lone:
            return ids, lengths
        ends = np.sort(np.concatenate([np.flatnonzero(ids == self.sign_id), np.cumsum(lengths)[:-1], [len(ids)]]))
        inner = ids != self.sign_id
        before = np.concatenate([[0], np.cumsum(inner)])
        return ids[inner], np.diff(before[ends], prepend=0)

    def ids_of(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def clear(self) -> None:
        self.row: dict[str, int] = {}
        self.ids, self.offsets = np.zeros(1 << 16, np.uint32), np.zeros(1 << 14, np.int64)

    def learn(self, runs: list[str]) -> None:
        if len(self.row) + len(runs) > self.keep:
            self.clear()
        new = [x for x in runs if x not in self.row]
        if not new:
            return
        # an encoding takes far more memory than its ids
        found = [self.coded(new[k : k + SLICE]) for k in range(0, len(new), SLICE)]
        ids, lengths = (np.concatenate(x) for x in zip(*found, strict=True))
        n, used = len(self.row), self.offsets[len(self.row)]
        stop = used + len(ids)
        while len(self.ids) < stop:
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        while len(self.offsets) < n + len(new) + 1:
            self.offsets = np.concatenate([self.offsets, np.zeros_like(self.offsets)])
        self.ids[used:stop] = ids
        self.offsets[n + 1 : n + len(new) + 1] = used + np.cumsum(lengths)
        self.row.update(zip(new, range(n, n + len(new)), strict=True))

    def split(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """A store row for each run of the texts, in order, and the first run of each text (one more entry than texts)."""
        texts = pc.fill_null(texts, "")
        plain = pc.ascii_lower(texts) if self.lowers else texts
        if self.cuts:
            plain = pc.replace_substring_regex(plain, r"([a-zß-öø-ÿ])([.,;:!?])", r"\1 \2")
        special = pc.match_substring(texts, "<|")  # may be a special token, which is told by its case
        if pc.any(special).as_py():
            plain = pc.if_else(special, texts, plain)
        if self.parts:
            runs = pc.ascii_split_whitespace(plain)
        else:
            runs = pa.ListArray.from_arrays(pa.array(range(len(texts) + 1), pa.int32()), texts)
        flat = runs.flatten()
        coded = flat.dictionary_encode()
        names = coded.dictionary.to_pylist()
        self.learn(names)
        rows = np.fromiter((self.row[x] for x in names), np.int64, len(names))
        first = runs.offsets.to_numpy().astype(np.int64)
        codes = coded.indices.to_numpy().astype(np.int64)
        return rows[codes], first - first[0]

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and the first id of each text (one more entry than texts)."""
        rows, first = self.split(texts)
        begin = self.offsets[rows]
        n = self.offsets[rows + 1] - begin
        ends = np.concatenate([[0], np.cumsum(n)])
        at = np.repeat(begin - ends[:-1], n) + np.arange(ends[-1])
        return self.ids[at], ends[first]

    def lengths(self, texts: pa.Array) -> np.ndarray:
        rows, first = self.split(texts)
        ends = np.concatenate([[0], np.cumsum(self.offsets[rows + 1] - self.offsets[rows])])
        return np.diff(ends[first])


@functools.lru_cache(maxsize=2)
def encoder(vocabulary: str) -> ChunkEncoder:
    """One encoder a Python worker, whatever tasks it runs."""
    return ChunkEncoder(vocabulary)
