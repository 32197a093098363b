"""Plain versions of the operators, and documents with hard cases."""

import random
import re

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(text or "")


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def shingles(ws, k):
    if not ws:
        return set()
    return {tuple(ws[i : i + k]) for i in range(len(ws) - k + 1)} if len(ws) >= k else {tuple(ws)}


def corpus(seed=1, n=60):
    """Documents with exact and near copies, shared passages and lines, nulls, blanks, and odd white space."""
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)] + ["Éa", "ß", "x y", "😀"]
    make = lambda k: [rng.choice(vocabulary) for _ in range(k)]
    passage, line = " ".join(make(60)), "A line that Recurs everywhere"
    texts = []
    for i in range(n):
        ws = make(rng.choice([1, 2, 3, 8, 9, 10, 11, 12, 19, 20, 40, 120, 300]))
        if i % 7 == 0:
            at = rng.randint(0, len(ws))
            ws[at:at] = passage.split(" ")
        t = "".join(w + rng.choice([" ", " ", "\n", "\t", " \x0b "]) for w in ws)
        if i % 4 == 0:
            t += "\n " + line.swapcase() + " \n" + t[:10]
        texts.append(t)
    for i in range(0, n, 3):
        ws = texts[i].split(" ")
        for _ in range(rng.randint(0, 2)):
            ws[rng.randrange(len(ws))] = rng.choice(vocabulary)
        texts.append(" ".join(ws))
    texts += [texts[5]] * 4 + [None, "", " \n\t ", "\n\n", "one", "one two", None]
    rows = [(i, t, rng.choice(["en", "fr", None]), f"src{i % 5}", len(t or "")) for i, t in enumerate(texts)]
    return rows + [rows[3], rows[3]]
