import functools
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from tessera.llm import packing, token_counts
from tessera.llm.packing import binary_lengths


@functools.cache
def tokenizer():
    return Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))


def ids_of(text):
    return tokenizer().encode(text or "", add_special_tokens=False).ids


def test_binary_lengths():
    assert binary_lengths(1, 8) == [1]
    assert binary_lengths(23, 8) == [8, 8, 4, 2, 1]
    assert all(sum(binary_lengths(n, 64)) == n for n in range(1, 400))


def check(rows, pieces):
    found = defaultdict(list)
    for p in pieces:
        found[p["doc_id"]].append(p)
    want = defaultdict(list)
    for d, t in rows:
        want[d].append(ids_of(t) + [1])
    assert found.keys() == want.keys()
    for d, lists in want.items():
        whole = Counter(np.array(x, "<u4").tobytes() for x in lists)
        own, got, parts = sorted(found[d], key=lambda p: p["sequence_id"]), Counter(), b""
        for p in own:
            assert p["start"] * 4 == len(parts) and p["length"] * 4 == len(p["ids"]) and p["ids_crc32"] == zlib.crc32(p["ids"])
            assert p["length"] == 1 << p["bucket"] <= 2048 and p["offset"] == 0
            parts += p["ids"]
            if len(parts) == 4 * p["doc_tokens"]:
                got[parts] += 1
                parts = b""
        assert got == whole and not parts
    assert len({p["sequence_id"] for p in pieces}) == len(pieces)


def test_pieces_are_the_documents(docs, doc_rows):
    check(doc_rows, packing.pack(docs).collect())


def test_odd_rows(odd, odd_rows, none):
    check(odd_rows, packing.pack(odd).collect())
    assert packing.pack(none).count() == 0


def test_buckets(docs, spark, tmp_path):
    packing.write_buckets(packing.pack(docs), str(tmp_path / "b"))
    assert spark.read.parquet(str(tmp_path / "b")).where("length(ids) <> 4 * shiftleft(1, bucket)").count() == 0


def test_special_strings(spark):
    text = "a<|endoftext|>b ’s don't É́ 2 3\u00a04 <|startoftext|>"
    got = packing.pack(spark.createDataFrame([(1, text)], "doc_id long, text string")).orderBy("start").collect()
    assert b"".join(r["ids"] for r in got) == np.array([*ids_of(text), 1], "<u4").tobytes()


def test_histogram(odd, odd_rows, none, docs, doc_rows):
    for df, rows in ((odd, odd_rows), (docs, doc_rows)):
        n = sorted(len(ids_of(t)) for _, t in rows)
        hist = token_counts.histogram(token_counts.lengths(df)).orderBy("n_tokens").collect()
        assert [r["n_tokens"] for r in hist] == sorted(set(n))
        for r in hist:
            x = r["n_tokens"]
            assert r["n_docs"] == n.count(x) and r["docs_from"] == sum(k >= x for k in n) and r["tokens_from"] == sum(k for k in n if k >= x)
            assert r["kept_tokens"] == sum(min(k, x) for k in n) and abs(r["share_to"] - sum(k <= x for k in n) / len(n)) < 1e-12
    assert token_counts.histogram(token_counts.lengths(none)).count() == 0


def test_answers(docs, doc_rows):
    n = sorted(len(ids_of(t)) for _, t in doc_rows)
    hist = token_counts.histogram(token_counts.lengths(docs)).cache()
    got = {r["limit"]: (r["docs_over"], r["kept_tokens"]) for r in token_counts.answer(hist, [0, 100, 777, 10**6]).collect()}
    assert got == {x: (sum(k > x for k in n), sum(min(k, x) for k in n)) for x in (0, 100, 777, 10**6)}
    got = {r["share"]: r["n_tokens"] for r in token_counts.quantiles(hist, [0.5, 1.0]).collect()}
    assert got == {q: min(x for x in n if sum(k <= x for k in n) >= q * len(n)) for q in (0.5, 1.0)}


def test_tokenizers_of_other_kinds(tmp_path):
    import pyarrow as pa
    from tokenizers import Tokenizer, models, normalizers, pre_tokenizers

    from tessera.llm.tokenizing import ChunkEncoder

    texts = ["Hello WORLD. a.b  c\n\td!", "", None, "hello world", "x" * 50 + " Y,z"]
    vocabulary = {c: i for i, c in enumerate(sorted(set("".join(t or "" for t in texts)) | set("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ 0123456789.,;:!?'éïüÜñÑúÉTﬁ\n\tĠ")))}
    for k, (normal, pre) in enumerate([(None, pre_tokenizers.WhitespaceSplit()), (normalizers.Lowercase(), pre_tokenizers.Whitespace()), (None, pre_tokenizers.ByteLevel(add_prefix_space=False)), (None, None)]):
        own = Tokenizer(models.BPE(vocab={**vocabulary, "he": len(vocabulary), "HE": len(vocabulary) + 1}, merges=[("h", "e")]))
        if normal:
            own.normalizer = normal
        if pre:
            own.pre_tokenizer = pre
        own.save(f"{tmp_path}/{k}.json")
        code = ChunkEncoder(f"{tmp_path}/{k}.json")
        ids, first = code.encode(pa.array(texts))
        assert [ids[a:b].tolist() for a, b in zip(first[:-1], first[1:], strict=True)] == [own.encode(t or "", add_special_tokens=False).ids for t in texts], k
        assert code.lengths(pa.array(texts)).tolist() == np.diff(first).tolist()


def test_runs_joined_for_an_encoding_keep_their_ids():
    """Distinct runs are encoded many to a text; each gets the ids it has alone, odd ones and parts of added tokens included."""
    from tessera.llm.tokenizing import JOINED, SLICE, ChunkEncoder

    code = ChunkEncoder("word_bpe_49k.json")
    odd = ["", "<|", "<|startoftext|", "x<", "<|endoftext|>", "a<|endoftext|>b", "|>", "text|>", "́x", "é", "ﬁ", "\x00", "a‍", "%%%", "it's", "ÜBER9", "", ""]
    runs = [f"{w}{k * 7919}" if k % 3 else w for k, w in enumerate(odd * 20)]
    seen: list[int] = []
    inner, code.tokenizer = code.tokenizer, None

    class Counted:
        def encode_batch_fast(self, texts, **options):
            seen.append(len(texts))
            return inner.encode_batch_fast(texts, **options)

    code.tokenizer = Counted()
    for some in (runs, runs[:1], runs[: JOINED - 1], runs[:JOINED], runs[: JOINED + 1], [*runs, "q<|startoftext|>r"], ["", ""]):
        ids, lengths = code.coded(some)
        alone = [inner.encode(x, add_special_tokens=False).ids for x in some]
        assert lengths.tolist() == [len(x) for x in alone]
        assert ids.tolist() == [i for x in alone for i in x]
    assert seen[0] == -(-len(runs) // JOINED) and SLICE > JOINED
    code.tokenizer, code.sign = inner, ""  # a tokenizer without added tokens
    assert code.coded(runs)[0].tolist() == [i for x in runs for i in inner.encode(x, add_special_tokens=False).ids]
