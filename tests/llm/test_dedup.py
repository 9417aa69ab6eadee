import random

import numpy as np
import pytest
from llm_brute import awkward, awkward_rows, sentence, simhash, substring, words
from pyspark.sql import functions as F

from metalens.llm import simhash as sh
from metalens.llm import substring as sub
from metalens.llm.components import components


def _simhash_rows(frame):
    out = frame.alias("d").join(sh.near_duplicates(frame).select("doc_id").distinct(), "doc_id", "inner")  # every id is there
    assert out.select("doc_id").distinct().count() == frame.filter("doc_id IS NOT NULL").select("doc_id").distinct().count()
    return sorted(((r.doc_id, r.fp % (1 << 64), r.component_id) for r in sh.near_duplicates(frame).collect()), key=str)


def _expected(rows):
    found = simhash(rows)
    return sorted(((i, *found[i, t]) for i, t in rows), key=str)


def test_simhash_equals_brute_force_on_awkward_rows(spark):
    assert _simhash_rows(awkward(spark)) == _expected(awkward_rows())


def test_simhash_links_a_large_group_of_near_copies_across_chunks(spark):
    rng = random.Random(5)
    own = sentence(rng, 200).split()
    rows = []
    for i in range(300):
        copy = list(own)
        for _ in range(rng.randrange(3)):
            copy[rng.randrange(len(copy))] = f"x{rng.randrange(99)}"
        rows.append((i, " ".join(copy)))
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    distinct = sh.fingerprints(frame).select("fp").distinct()
    links = sh.links(distinct, chunk=16)  # many chunks for one key
    assert links.count() < 40 * distinct.count()  # no group's pairs are all listed
    roots = {r.node: r.root for r in components(links).collect()}
    groups = {}
    for (_, text), (fp, component) in simhash(rows).items():
        signed = fp - (1 << 64) if fp >> 63 else fp
        groups.setdefault(component, set()).add(roots.get(signed, signed))
    assert all(len(g) == 1 for g in groups.values()) and len(set().union(*groups.values())) == len(groups)


@pytest.mark.parametrize("blocks", [4, 5, 6])
def test_block_masks_meet_all_pairs_within_the_bits(blocks):
    rng = np.random.default_rng(blocks)
    masks = sh.block_masks(blocks, 3)
    for _ in range(500):
        x = 0
        for b in rng.choice(64, 3, replace=False):
            x |= 1 << int(b)
        assert any(x & m == 0 for m in masks)


def test_simhash_keep_first_leaves_one_row_of_each_component(spark):
    frame = awkward(spark)
    kept = sh.keep_first(frame)
    assert kept.columns == frame.columns
    # one row of each group of linked fingerprints, whether or not groups share a smallest id
    by_fp = {f: c for f, c in simhash(awkward_rows()).values()}
    groups = []
    for f in by_fp:
        linked = [g for g in groups if any((f ^ o).bit_count() <= 3 for o in g)]
        groups = [g for g in groups if g not in linked] + [{f}.union(*linked)]
    assert sorted((r.doc_id for r in kept.select("doc_id").collect()), key=str) == sorted((by_fp[min(g)] for g in groups), key=str)
    unique = awkward(spark, [(i, t) for i, t in awkward_rows() if i not in (15, 16, None)])
    assert {r.doc_id for r in sh.keep_first(unique).collect()} == {c for _, c in simhash([(r.doc_id, r.text) for r in unique.collect()]).values()}


def test_simhash_keep_first_keeps_unlinked_rows_that_share_an_id_or_have_none(spark):
    rng = random.Random(8)
    a, b, c, d, e = (sentence(rng, 40) for _ in range(5))
    rows = [(None, a), (None, b), (None, a), (7, c), (7, d), (7, c), (None, e), (3, e), (9, e)]
    kept = sh.keep_first(awkward(spark, rows)).select("doc_id", "text").collect()
    assert sorted(map(tuple, kept), key=str) == sorted([(None, a), (None, b), (7, c), (7, d), (3, e)], key=str)


def test_components_of_a_long_chain_and_a_star(spark):
    chain = [(i + 1, i) for i in range(70)]
    star = [(1000 + i, 999) for i in range(50)]
    links = spark.createDataFrame(chain + star + [(5, 5), (5, 4)], "u long, v long")
    got = {r.node: r.root for r in components(links).collect()}
    assert got == {i: 0 for i in range(71)} | {1000 + i: 999 for i in range(-1, 50)}


def test_dedup_of_empty_tables(spark):
    empty = awkward(spark, [])
    assert sh.near_duplicates(empty).count() == sh.keep_first(empty).count() == sub.without_repeats(empty).count() == sub.strip_repeats(empty).count() == 0
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def _substring_rows(frame, **options):
    out = sub.without_repeats(frame, **options)
    return sorted(((r.doc_id, r.n_words, r.n_removed, r.k) for r in out.select("row.doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("k")).collect()), key=str)


def test_substring_equals_brute_force_on_awkward_rows(spark):
    # rows that share an id with another text are ordered by digest, so they are left to the next test
    rows = [r for r in awkward_rows() if r[0] not in (16, None)] + [(None, awkward_rows()[0][1] + " x y z")]
    found = substring(rows)
    assert _substring_rows(awkward(spark, rows)) == sorted(((i, *found[i, t]) for i, t in rows), key=str)


def test_substring_handles_equal_ids(spark):
    out = {(r[0], r[1], r[2]) for r in _substring_rows(awkward(spark))}
    assert (16, 25, 0) in out and (16, 26, 0) in out  # texts of their own
    assert (15, 120, 120) in out and len(_substring_rows(awkward(spark))) == len(awkward_rows())


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_substring_finds_matches_at_any_alignment(spark, seed):
    rng = random.Random(seed)
    shared = [sentence(rng, 20 + rng.randrange(30)) for _ in range(6)]
    rows = []
    for i in range(60):
        parts = [sentence(rng, rng.randrange(40)) for _ in range(2)]
        parts.insert(1, rng.choice([*shared, "", sentence(rng, 19)]))
        rows.append((i, " ".join(parts)))
    found = substring(rows)
    assert sum(v[1] for v in found.values()) > 0
    assert _substring_rows(awkward(spark, rows, extra=False)) == sorted(((i, *found[i, t]) for i, t in rows), key=str)
    narrow = substring(rows, 5)
    assert _substring_rows(awkward(spark, rows, extra=False), words=5, period=3, cover=(0, 1)) == sorted(((i, *narrow[i, t]) for i, t in rows), key=str)


def test_substring_rejects_what_is_no_difference_cover(spark):
    with pytest.raises(ValueError):
        sub.without_repeats(awkward(spark, []), period=13, cover=(0, 1, 2, 3))


def test_strip_repeats_changes_only_texts_with_repeats(spark):
    rows = [r for r in awkward_rows() if r[0] not in (15, 16, None)]
    frame = awkward(spark, rows)
    out = {r.doc_id: r for r in sub.strip_repeats(frame).collect()}
    found = substring(rows)
    for i, t in rows:
        assert (out[i].text == t) if not found[i, t][1] else out[i].text == " ".join(words(out[i].text)) and len(words(out[i].text)) == found[i, t][0] - found[i, t][1]
        assert out[i].kept == "own kept" and (out[i].n_chars == (None if out[i].text is None else len(out[i].text)))
