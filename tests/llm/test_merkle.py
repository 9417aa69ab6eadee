import hashlib
import random
import zlib

import pytest
from llm_brute import CLASHES, awkward_rows
from pyspark.sql import functions as F

from metalens.llm import merkle

FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def tree(nodes, fanout):
    """(root, a path of (before, after) for each node)."""
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for k, i in enumerate(at):
            run = nodes[i // fanout * fanout:i // fanout * fanout + fanout]
            paths[k].append(("".join(run[:i % fanout]), "".join(run[i % fanout + 1:])))
        at = [i // fanout for i in at]
        nodes = [H(*nodes[j:j + fanout]) for j in range(0, len(nodes), fanout)]
    return nodes[0], paths


def touched(doc_id):
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 2 == 0


def brute(rows, fanout=3):
    """Sorted (doc_id, leaf, subroot, root, proof, folded root) of rows (doc_id, source, lang, n_chars, text)."""
    by = {}
    for r in rows:
        by.setdefault(r[1], []).append((r[0] is not None, r[0] or 0, H(*map(field, r)), r))
    own = {}
    for source, leaves in by.items():
        leaves.sort(key=lambda x: x[:3])
        own[source] = tree([x[2] for x in leaves], fanout)
    order = sorted(own, key=lambda s: (s is not None, (s or "").encode()))
    root, above = tree([own[s][0] for s in order], fanout) if order else ("", [])
    above, out = dict(zip(order, above, strict=True)), []
    for source, leaves in by.items():
        for (_, _, leaf, r), path in zip(leaves, own[source][1], strict=True):
            path = path + above[source]
            x = H(*map(field, (*r[:4], r[4].replace("\n", "") if r[4] is not None and touched(r[0]) else r[4])))
            for before, after in path:
                x = H(before, x, after)
            out.append((r[0], leaf, own[source][0], root, H(*("".join(e) for e in path)), x))
    return sorted(out, key=str)


def spark_rows(spark, rows, fanout=3, clash=True):
    docs = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")
    for name in ("grp", "id", "idx", "n", "child", "digest", "path", "now", "leaf", "g", "place", *CLASHES) if clash else ():
        if name not in docs.columns:
            docs = docs.withColumn(name, F.lit(f"own {name}"))
    tampered = F.when(F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0, F.lit(False)), F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    out = merkle.manifest(docs, FIELDS, "source", "doc_id", fanout, {"text": tampered})
    out = out.select("id", *(merkle.as_text(F.col(c)).alias(c) for c in ("leaf", "subroot", "root")), merkle.proof_digest(F.col("path")), merkle.as_text(merkle.folded(F.col("now"), F.col("path"))))
    return sorted(map(tuple, out.collect()), key=str)


def awkward_documents():
    rng = random.Random(5)
    rows = [(i, rng.choice([None, "", "a", "é", "z"]), rng.choice([None, "en"]), rng.choice([None, len(t or "")]), t) for i, t in awkward_rows()]
    rows += [(100 + i, "hot", "en", i, f"line {i}\nnext\n" if i % 3 else None) for i in range(85)]
    return rows + [(500, "alone", None, 0, ""), (None, None, None, None, None), (None, None, None, None, None), (7, "hot", "en", 1, "same"), (7, "hot", "en", 1, "same")]


@pytest.mark.parametrize("fanout", [3, 2])
def test_manifest_equals_brute_force(spark, fanout):
    rows = awkward_documents()
    got = spark_rows(spark, rows, fanout)
    assert got == brute(rows, fanout)
    changed = [r for r in rows if touched(r[0]) and r[4] and "\n" in r[4]]
    assert sum(r[5] != r[3] for r in got) == len(changed) > 0  # each change shows, and nothing else does


@pytest.mark.parametrize("n", [0, 1, 4, 10])
def test_manifest_of_one_group_of_any_size(spark, n):
    rows = [(i, "s", "en", 1, f"t{i}\n") for i in range(n)]
    assert spark_rows(spark, rows, clash=False) == brute(rows)


def test_any_changed_field_fails_and_unchanged_rows_pass(spark):
    docs = spark.createDataFrame([(i, f"s{i % 2}", None, i, "x") for i in range(20)], "doc_id long, source string, lang string, n_chars long, text string")
    for name, other in (("lang", F.lit("")), ("n_chars", F.col("n_chars") + 1), ("text", F.lit(None).cast("string"))):
        out = merkle.manifest(docs, FIELDS, "source", "doc_id", changed={name: F.when(F.col("doc_id") == 4, other).otherwise(F.col(name))})
        assert [r.id for r in out.filter(merkle.folded(F.col("now"), F.col("path")) != F.col("root")).collect()] == [4]
    same = merkle.manifest(docs, FIELDS, "source", "doc_id")
    assert same.filter(merkle.folded(F.col("leaf"), F.col("path")) == F.col("root")).count() == 20
    assert same.select("root").distinct().count() == 1


def test_root_does_not_depend_on_partitions(spark):
    rows = awkward_documents()
    docs = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")
    roots = {bytes(merkle.manifest(docs.repartition(k), FIELDS, "source", "doc_id").select("root").first()[0]) for k in (1, 7)}
    assert len(roots) == 1


def test_fanout_of_one_is_refused(spark):
    with pytest.raises(ValueError):
        merkle.manifest(spark.createDataFrame([(1, "a")], "doc_id long, source string"), ["doc_id"], "source", "doc_id", fanout=1)
