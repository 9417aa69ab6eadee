"""Plain Python versions of the operators' contracts, and awkward input rows."""

import hashlib
import random
import re

import xxhash

WORDS = re.compile("[^\x20\x09-\x0D]+")
CLASHES = ("n_words", "kept", "fingerprint", "fp", "row", "tie", "doc", "id", "h", "key", "anchors", "firsts", "part", "length", "piece", "score", "toxic",
           "lang", "source", "verdict", "host", "payload", "record_type", "start", "component_id", "n_chars")


def words(text):
    return WORDS.findall(text or "")


def ascii_lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def fingerprint(text, n=3):
    own = words(ascii_lower(text))
    shingles = [" ".join(own[i:i + n]) for i in range(max(1, len(own) - n + 1))] if own else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def simhash(rows, bits=3):
    """{(id, text): (fingerprint, component)} over (id, text) rows."""
    fps = {r: fingerprint(r[1]) for r in set(rows)}
    distinct = sorted(set(fps.values()))
    root = {f: f for f in distinct}

    def find(f):
        while root[f] != f:
            f = root[f]
        return f

    for i, a in enumerate(distinct):
        for b in distinct[:i]:
            if (a ^ b).bit_count() <= bits:
                root[find(a)] = find(b)
    least = {}
    for (i, _), f in fps.items():
        least[find(f)] = min((x for x in (least.get(find(f)), i) if x is not None), default=None)
    return {r: (f, least[find(f)]) for r, f in fps.items()}


def substring(rows, n=20):
    """{(id, text): (n_words, n_removed, kept_sha256)}; equal rows are one document."""
    seen, out = set(), {}
    for i, text in sorted(set(rows), key=lambda r: (r[0] is not None, r[0] or 0)):
        own = words(text)
        gone = [False] * len(own)
        for j in range(len(own) - n + 1):
            window = tuple(own[j:j + n])
            if window in seen:
                gone[j:j + n] = [True] * n
            seen.add(window)
        kept = " ".join(w for w, g in zip(own, gone, strict=True) if not g)
        out[i, text] = len(own), sum(gone), hashlib.sha256(kept.encode()).hexdigest()
    return out


def quality(text):
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed)."""
    own, text = words(text), text or ""
    lines, dup = set(), 0
    for line in text.split("\n"):
        if WORDS.search(line):
            dup += line in lines
            lines.add(line)
    windows = [tuple(own[i:i + 8]) for i in range(len(own) - 7)]
    covered = {j for i, w in enumerate(windows) if windows.count(w) > 1 for j in range(i, i + 8)}
    return (len(own), sum(map(len, own)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered), len(own) < 20 or 100 * len(covered) > 30 * len(own))


def contamination(text, items, n=10):
    """(n_words, n_hit, sorted item ids) for items {id: text}."""
    pattern = re.compile("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    own, hit, found = pattern.findall(ascii_lower(text)), set(), set()
    for i, t in items:
        its = pattern.findall(ascii_lower(t))
        width = min(n, len(its))
        if i is None or not width:
            continue
        known = {tuple(its[j:j + width]) for j in range(len(its) - width + 1)}
        for j in range(len(own) - width + 1):
            if tuple(own[j:j + width]) in known:
                hit.update(range(j, j + width))
                found.add(i)
    return len(own), len(hit), sorted(found)


def sentence(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


def awkward_rows():
    """(id, text): nulls, blanks, a very long text, copies, repeated rows, shared passages, equal ids."""
    rng = random.Random(3)
    passage, base = sentence(rng, 30), sentence(rng, 120)
    long = sentence(rng, 30_000, 50_000)
    rows = [(1, base), (2, base), (3, base.replace("w1 ", "w2 ", 1)), (4, None), (5, ""), (6, " \n\t "), (7, "One"), (8, "one two"), (9, "ONE TWO three"),
            (10, sentence(rng, 40) + " " + passage + "\n" + sentence(rng, 15)), (11, passage + " " + passage), (12, sentence(rng, 8) + "  " + passage + " "),
            (13, long), (14, long + " tail"), (None, sentence(rng, 50)), (None, passage), (15, base), (15, base), (16, sentence(rng, 25)), (16, sentence(rng, 26)),
            (17, "Ünïcode ÉTÉ\x0bvertical\x0cfeed\u00a0nbsp " * 6), (18, "same line\nsame line\n\nsame line\nother"), (19, "*** ### $$$ " * 12), (20, "LOUD WORDS HERE " * 10),
            (-5, base + " end"), (21, "<|endoftext|> plain a  b \n\n c\td\r\ne 日本語 " * 3), (22, " ".join(["a b c d e f g h"] * 9))]
    return rows


def awkward(spark, rows=None, extra=True):
    """The rows as a frame, with extra columns whose names operators use themselves."""
    frame = spark.createDataFrame(awkward_rows() if rows is None else rows, "doc_id long, text string")
    from pyspark.sql import functions as F

    for name in CLASHES if extra else ():
        frame = frame.withColumn(name, F.lit(f"own {name}") if name != "n_chars" else F.length("text").cast("long"))
    return frame
