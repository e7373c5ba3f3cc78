"""The whole result of decontamination against a second implementation on plain strings, and its recall on re-parameterised questions."""

import random
import re
from collections import defaultdict

from tessera.llm import decontam as D

LETTERS = "A-Za-z\\u0080-\\U0010ffff"
WORD = re.compile(f"[{LETTERS}]+(?:[0-9]+(?:[.,][0-9]+)*)?|[0-9]+(?:[.,][0-9]+)*")


def low(word):
    return re.sub("[A-Z]", lambda m: m[0].lower(), word)


def words(text):
    """(word, opens a sentence, follows closely) of each word."""
    out, end = [], None
    for m in WORD.finditer(text):
        gap = text[end : m.start()] if end is not None else None
        out.append((m[0], gap is None or bool(re.search(r"[.!?:;\n]", gap)), bool(gap) and not re.search(r"[^\x20\x09-\x0D'-]", gap)))
        end = m.end()
    return out


def form(text, openings):
    """(template, slot or None, place, number of words) of each word of one form."""
    out = []
    was_number = False
    for place, (w, opens, close) in enumerate(words(text)):
        said = low(w) in D.NUMBER_WORDS
        digits = w[0].isdigit() and w[0] in "0123456789"
        unit = was_number and not opens and place > 0 and low(w) in D.UNITS and not digits and not said
        number = digits or said
        name = "A" <= w[0] <= "Z" and not number and not unit and (not opens or openings)
        kind = "NUM" if number else "UNIT" if unit else "NAME" if name else low(w)
        last = out[-1] if out else None
        if last and close and not opens and ((name and last[4] == "name") or (said and last[4] == "said")):
            last[1].append(low(w))
        else:
            out.append([kind, [low(w)] if number or unit or name else None, place, None, "name" if name else "said" if said else ""])
        was_number = number
    for t in out:
        if t[4] == "said":
            t[1] = [str(D.number_of([D.NUMBER_WORDS[x] for x in t[1]]))]
    return [(t[0], None if t[1] is None else tuple(t[1]), t[2]) for t in out]


def spans(tokens):
    """(key, start, end, narrow) of the windows of five and of the widened ones."""
    for i in range(len(tokens) - D.WIDTH + 1):
        j = i + D.WIDTH
        if sum(t[1] is None for t in tokens[i:j]) >= D.LITERALS:
            yield ("narrow", *(t[0] for t in tokens[i:j])), i, j, True
            continue
        for a, b in ((i, next((k for k in range(i, len(tokens) + 1) if sum(t[1] is None for t in tokens[i:k]) == D.LITERALS), None)), (next((k for k in range(j, -1, -1) if sum(t[1] is None for t in tokens[k:j]) == D.LITERALS), None), j)):
            if a is not None and b is not None:
                yield ("wide", *(t[0] for t in tokens[a:b])), a, b, False


def located(tokens, found):
    return {(key, tokens[i][2], tuple(t[1] for t in tokens[i:j]), narrow) for key, i, j, narrow in found}


def item_forms(text):
    forms = [form(text, False)]
    if any(o and "A" <= w[0] <= "Z" for w, o, _ in words(text)):
        forms.append(form(text, True))
    every = []
    for tokens in forms:
        found = list(spans(tokens))
        if D.LITERALS <= len(tokens) < D.WIDTH and sum(t[1] is None for t in tokens) >= D.LITERALS:
            found.append((("narrow", *(t[0] for t in tokens)), 0, len(tokens), True))
        every.append(located(tokens, found))
    plain = [low(w) for w, *_ in words(text)]
    if plain and not every[0]:
        every[0] = {(("plain", *plain), 0, (None,) * len(plain), False)}
    return every, len(plain)


def document(text, lengths):
    found = set()
    for openings in (False, True):
        tokens = form(text, openings)
        short = [(("narrow", *(t[0] for t in tokens[i : i + w])), i, i + w, True) for w in (3, 4) for i in range(len(tokens) - w + 1) if sum(t[1] is None for t in tokens[i : i + w]) >= D.LITERALS]
        found |= located(tokens, [*spans(tokens), *short])
    own = words(text)
    for w in lengths:
        for i in range(len(own) - w + 1):
            if w > 2 or own[i][1] and (i + w == len(own) or own[i + w][1]):
                found.add((("plain", *(low(x) for x, *_ in own[i : i + w])), i, (None,) * w, False))
    return found


def brute(doc, item):
    """(n_windows, containment, consistency) of a document and an item."""
    forms, n_words = item_forms(item)
    found = document(doc, {len(k) - 1 for f in forms for k, *_ in f if k[0] == "plain"})
    by_key = defaultdict(list)
    for key, pos, slots, _ in found:
        by_key[key].append((pos, slots))
    best = None
    for f in forms:
        keys, narrow_keys = {k for k, *_ in f}, {k for k, *_, n in f if n}
        rows = sorted({(pos - p, key, slots, own, narrow) for key, p, own, narrow in f for pos, slots in by_key[key]}, key=lambda r: r[0])
        run, places = 0, defaultdict(list)
        for k, r in enumerate(rows):
            run += k > 0 and r[0] - rows[k - 1][0] > n_words / 4
            for place in ((0, r[0]), (1, run), (2, 0)):
                places[place].append(r)
        for group in places.values():
            hit = {r[1] for r in group}
            share = max(len(hit) / len(keys), len(hit & narrow_keys) / len(narrow_keys) if narrow_keys else 0)
            means = defaultdict(set)
            for _, _, slots, own, _ in group:
                for a, b in zip(own, slots, strict=True):
                    if a is not None or b is not None:
                        means[a].add(b)
            same = sum(len(v) == 1 or k in v for k, v in means.items()) / len(means) if means else 1.0
            best = max(best or (0,), (min(share, same), share, same, len(hit)))
    return best and (best[3], best[1], best[2])


def check(spark, docs, items):
    got = {}
    frames = [spark.createDataFrame(x, f"{n} long, text string") for x, n in ((docs, "doc_id"), (items, "item_id"))]
    for r in D.contaminated(D.contamination(*frames)).collect():
        got[r["doc_id"], r["item_id"]] = (r["n_windows"], round(r["containment"], 9), round(r["consistency"], 9))
    want = {(d, i): b for d, t in docs for i, x in items if (b := brute(t, x)) and b[1] >= D.CONTAINMENT and b[2] >= D.CONSISTENCY}
    assert got == {k: (n, round(c, 9), round(s, 9)) for k, (n, c, s) in want.items()}
    return set(got)


ITEMS = [
    (1, "Anna has 12 apples left at home today"),
    (2, "Is 3 km + 4 km = 7 km or 5 kg + 2 kg = 7 kg"),
    (3, "Mary Ann Smith drives from New York to Boston at 50 miles per hour. How long does it take her?"),
    (4, "A shop sells twenty-five pens for 4 dollars each and buys one hundred more"),
    (5, "too short"),
    (6, "Yes"),
    (7, "Solve 3x + 4 = 10"),
    (8, "Which of the following is the largest number"),
    (9, "Which of the following is the largest planet"),
    (10, "four words are here"),
    (11, "1 2 3 4 5 6 7"),
    (12, ""),
]


def test_whole_result(spark):
    docs = [
        (1, "Lola has 31 apples left at home today. Then Anna left."),
        (2, "x y. Is 3 km + 4 km = 7 km or 5 kg + 2 kg = 7 kg"),
        (3, "Bob drives from Rome to Ostia at 80 miles per hour. How long does it take her? No"),
        (4, "A shop sells 25 pens for 4 dollars each and buys 100 more"),
        (5, "a shop sells thirty pens for six dollars each and buys two hundred and more"),
        (6, "It was too short for us. Too short. Really"),
        (7, "Yes. And yes it is"),
        (8, "so solve 3x + 4 = 10 at home"),
        (9, "Which of the following is the largest number? Which of the following is the largest planet?"),
        (10, "Which of the following is it"),
        (11, ""),
        (12, "5 words are here and four words are here"),
        (13, "1 2 3 4 5 6 7"),
        (14, "Lola has 31 apples left at home today and Anna has 2 apples left at home today"),
    ]
    found = check(spark, docs, ITEMS)
    assert {(1, 1), (2, 2), (3, 3), (4, 4), (6, 5), (7, 6), (8, 7), (9, 8), (9, 9), (13, 11)} <= found and (10, 8) not in found


def test_random_texts(spark):
    rng = random.Random(5)
    parts = ["the", "farm", "cow", "Anna", "Bob", "12", "7", "three", "twenty", "km", "has", "and", "then", "New", "York", "buys", "five", "5.5", "it"]
    text = lambda n: " ".join(rng.choice(parts) + rng.choice(["", "", "", "", ".", ",", "-", "\n"]) for _ in range(n))
    items = [(i, text(rng.choice([1, 2, 3, 4, 6, 9, 14]))) for i in range(25)]
    docs = []
    for d in range(60):
        i, t = rng.choice(items)
        edited = " ".join(rng.choice(["Carla", "31", "nine"]) if rng.random() < 0.08 else w for w in t.split(" "))
        docs.append((d, text(rng.randrange(6)) + " " + edited + " " + text(rng.randrange(6))))
    assert len(check(spark, docs, items)) > 30


QUESTIONS = [
    "{N} has {a} apples and gives {b} apples to {M} so how many apples are left with {N} now",
    "A train leaves {C} at {a} km per hour and another leaves {D} at {b} km per hour when do they meet",
    "{N} saved {a} dollars last week. {M} saved {b} dollars more than {N}. How much did {M} save?",
    "If {a} workers build a wall in {b} days how long do {c} workers need for the same wall",
    "{N} is {a} years old and {M} is {b} years older. How old will {M} be in {c} years?",
]


def filled(rng, question):
    person = lambda: rng.choice(["Anna", "Mary Ann", "Bob", "Carl Otto", "Dora", "Erik"])
    city = lambda: rng.choice(["Paris", "New York", "Rome", "San Marino"])
    number = lambda: rng.choice([str(rng.randrange(2, 400)), rng.choice(["two", "twelve", "twenty-five", "one hundred"])])
    names = rng.sample(["Anna", "Mary Ann", "Bob", "Carl Otto", "Dora", "Erik"], 2)
    return question.format(N=names[0], M=names[1], C=city(), D=city(), a=number(), b=number(), c=number()) if person else ""


def test_recall_on_other_values(spark):
    rng = random.Random(9)
    items = [(i, filled(rng, q)) for i, q in enumerate(QUESTIONS)]
    docs = [(k, f"{rng.choice(['Homework.', 'see this:', ''])} {filled(rng, QUESTIONS[k % 5])}") for k in range(300)]
    frames = [spark.createDataFrame(x, f"{n} long, text string") for x, n in ((docs, "doc_id"), (items, "item_id"))]
    got = {(r["doc_id"], r["item_id"]) for r in D.contaminated(D.contamination(*frames)).collect()}
    right = {(k, k % 5) for k in range(300)}
    assert len(got & right) >= 0.9 * len(right) and got <= right
