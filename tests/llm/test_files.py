import gzip
import hashlib
import os
import random
import struct
import zlib
from collections import defaultdict

import pyarrow as pa
import pytest
from llm_brute import awkward, awkward_rows, sentence
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import public_tokenizers
from metalens.llm import packing, token_store, warc
from metalens.llm.tokens import Encoder, tokenizer_spec

BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
ODD_TEXTS = ["", " ", "  a", "a  b", "a \n b\n\nc ", "tab\tq\r\nw", "a\x00b c", "a\x0bb \x0c c", "nbsp x  y", "em space", "<|endoftext|> x <|startoftext|>",
             "don't WE'LL it's", "日本語 テスト", "Straße ΟΔΥΣΣΕΥΣ İstanbul", "é à x", "x ́y", "foo, bar. 1234 5,6 %%%", "﻿hi", "a\x85b \x85", "ÀÖØöøÿ ×÷ Ÿ", "🙂 👩‍👩‍👧 ok"]


def _plain(path):
    return Tokenizer.from_file(path)


@pytest.mark.parametrize("path", [BYTE, WORD])
def test_encoder_gives_the_ids_of_whole_texts(path, spark):
    rng = random.Random(4)
    texts = ODD_TEXTS + [t or "" for _, t in awkward_rows() if len(t or "") < 10_000]
    texts += ["".join(rng.choice([" ", "  ", "\n", "a", "Bé", ",", "'s", "9", " ", "ß", "\t", "Ñandú"]) for _ in range(60)) for _ in range(300)]
    texts += [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect()]
    encoder = Encoder(tokenizer_spec(path))
    assert encoder.chunking == {BYTE: "spaced", WORD: "words"}[path]
    for _ in range(2):  # with and without what is remembered
        ids, counts = encoder.encode(pa.array(texts))
        at = 0
        for t, n, e in zip(texts, counts, _plain(path).encode_batch(texts, add_special_tokens=False), strict=True):
            assert ids[at:at + n].tolist() == e.ids, t[:80]
            at += n


@pytest.mark.parametrize("path", [BYTE, WORD])
def test_encoder_gives_the_ids_of_the_unmodified_tokenizer(path):
    rng = random.Random(6)
    texts = ["one <|endoftext|> two", *ODD_TEXTS, "a<|endoftext|>", "<|endoftext|><|endoftext|>  <|startoftext|>\n<|endoftext|>", "x  <|ENDOFTEXT|> <|endoftext |>", awkward_rows()[-2][1]]
    texts += ["".join(rng.choice([" ", "  ", "\n", "a", "Bé", ",", "<|", "|>", "\u00a0", "<|endoftext|>", "<|startoftext|>", "endoftext"]) for _ in range(40)) for _ in range(300)]
    encoder, plain = Encoder(tokenizer_spec(path)), Tokenizer.from_file(path)
    for _ in range(2):
        ids, counts = encoder.encode(pa.array(texts))
        want = [e.ids for e in plain.encode_batch(texts, add_special_tokens=False)]
        assert counts.tolist() == list(map(len, want)) and ids.tolist() == sum(want, [])
    assert want[0] == {BYTE: [505, 220, 50256, 734], WORD: [637, 49407, 1237]}[path]


@pytest.mark.parametrize("path", [BYTE, WORD])
def test_encoder_that_forgets_gives_the_same_ids(path):
    rng = random.Random(13)
    encoder, plain = Encoder(tokenizer_spec(path), memory=40), _plain(path)
    for _ in range(12):
        texts = [" ".join(rng.choice(["the", "a\n", "of", f"w{rng.randrange(500)}", "x\u2003y", "<|endoftext|>", "", "é"]) for _ in range(rng.randrange(30))) for _ in range(9)]
        ids, counts = encoder.encode(pa.array(texts))
        want = [e.ids for e in plain.encode_batch(texts, add_special_tokens=False)]
        assert counts.tolist() == list(map(len, want)) and ids.tolist() == sum(want, [])
    ids, counts = encoder.encode(pa.array([], pa.string()))
    assert len(ids) == len(counts) == 0


def test_encoder_cuts_and_splits_no_added_string():
    import json

    spec = json.loads(tokenizer_spec(WORD))
    for change, chunking in (({"content": "endof"}, "words"), ({"content": "end of"}, None), ({"content": "endof", "rstrip": True}, None)):
        own = json.dumps(spec | {"added_tokens": [spec["added_tokens"][0], spec["added_tokens"][1] | change]})
        text = "the endof, of end of  text endoftext"
        encoder = Encoder(own)
        assert encoder.chunking == chunking and encoder.encode(pa.array([text]))[0].tolist() == Tokenizer.from_str(own).encode(text, add_special_tokens=False).ids


def test_encoder_takes_whole_texts_for_other_tokenizers(tmp_path):
    from tokenizers.models import WordLevel
    from tokenizers.pre_tokenizers import Whitespace

    t = Tokenizer(WordLevel({"a": 0, "b": 1, "?": 2}, unk_token="?"))
    t.pre_tokenizer = Whitespace()
    e = Encoder(t.to_str())
    ids, counts = e.encode(pa.array(["a b", "", "c"]))
    assert e.chunking is None and ids.tolist() == [0, 1, 2] and counts.tolist() == [2, 0, 1]


def _crc(ids):
    return zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))


def test_token_store_round_trip(spark, tmp_dir):
    rows = [r for r in awkward_rows() if r[0] not in (16, None)]
    token_store.write_tokens(awkward(spark, rows), f"{tmp_dir}/s", WORD, 1)
    got = token_store.read_tokens(spark, f"{tmp_dir}/s").orderBy("start").collect()
    rows.sort(key=lambda r: r[0])
    want, start = [], 0
    for (i, _), e in zip(rows, _plain(WORD).encode_batch([t or "" for _, t in rows], add_special_tokens=False), strict=True):
        want.append((i, start, len(e.ids) + 1, e.ids + [1]))
        start += len(e.ids) + 1
    assert [(r.doc_id, r.start, r.n_tokens, r.ids) for r in got] == want
    crcs = {(r.doc_id, r.start): r.ids_crc32 for r in token_store.with_crc32(token_store.read_tokens(spark, f"{tmp_dir}/s")).collect()}
    assert crcs == {(i, s): _crc(ids) for i, s, _, ids in want}
    assert [r.n_tokens for r in token_store.read_metadata(spark, f"{tmp_dir}/s").orderBy("start").collect()] == [w[2] for w in want]


def test_token_store_handles_equal_and_null_ids_and_empty_tables(spark, tmp_dir):
    token_store.write_tokens(awkward(spark), f"{tmp_dir}/s", BYTE, 0)
    got = token_store.read_metadata(spark, f"{tmp_dir}/s").orderBy("start").collect()
    assert len(got) == len(awkward_rows()) and got[0].doc_id is None and got[1].doc_id is None
    ids = [r.doc_id for r in got if r.doc_id is not None]
    assert ids == sorted(ids) and all(b.start == a.start + a.n_tokens for a, b in zip(got, got[1:], strict=False))
    token_store.write_tokens(awkward(spark, []), f"{tmp_dir}/e", BYTE, 0)
    assert token_store.with_crc32(token_store.read_tokens(spark, f"{tmp_dir}/e")).count() == 0


def test_token_files_have_encodings_and_indexes_and_prune(spark, tmp_dir):
    import pyarrow.parquet as pq

    rows = [(i, sentence(random.Random(i), 60, 900)) for i in range(400)]
    token_store.write_tokens(spark.createDataFrame(rows, "doc_id long, text string"), f"{tmp_dir}/s", BYTE, 0, row_group_bytes=64 << 10, page_bytes=4 << 10)
    files = [f for f in sorted(os.listdir(f"{tmp_dir}/s/tokens")) if f.endswith(".parquet")]
    metas = [pq.ParquetFile(f"{tmp_dir}/s/tokens/{f}").metadata for f in files]
    for m in metas:
        for g in range(m.num_row_groups):
            cols = {m.row_group(g).column(c).path_in_schema: m.row_group(g).column(c) for c in range(m.num_columns)}
            assert "DELTA_BINARY_PACKED" in cols["doc_id"].encodings and "DELTA_BINARY_PACKED" in cols["local_start"].encodings
            ids = next(v for k, v in cols.items() if k.startswith("ids"))
            assert ids.has_dictionary_page and ids.compression == "ZSTD" and ids.has_column_index and ids.has_offset_index and cols["doc_id"].has_column_index
    plan = token_store.read_tokens(spark, f"{tmp_dir}/s").filter("doc_id = 7")
    assert plan.count() == 1
    meta = token_store.read_metadata(spark, f"{tmp_dir}/s")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(doc_id,7)" in plan._jdf.queryExecution().executedPlan().toString() and "ids" not in meta.split("ReadSchema")[1]


def _packed(frame, capacity):
    rows = packing.pack(frame, BYTE, 0, capacity).collect()
    by_sequence, by_doc = defaultdict(list), defaultdict(list)
    for r in rows:
        by_sequence[r.sequence_id].append(r)
        by_doc[r.doc_id].append(r)
    for own in by_sequence.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at and r.length >= 1
            at += r.length
        assert at <= capacity
    return rows, by_sequence, by_doc


@pytest.mark.parametrize("capacity", [2048, 64, 7])
def test_packing_places_every_piece_once(spark, capacity):
    rows = [r for r in awkward_rows() if r[0] not in (13, 14)]
    got, by_sequence, _ = _packed(awkward(spark, rows), capacity)
    want = []
    for (i, _), e in zip(rows, _plain(BYTE).encode_batch([t or "" for _, t in rows], add_special_tokens=False), strict=True):
        ids = [*e.ids, 0]
        first = len(ids) - (-(-len(ids) // capacity) - 1) * capacity
        cuts = [0, *range(first, len(ids) + 1, capacity)]
        want += [(i, k, a, b - a, _crc(ids[a:b])) for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False))]
    assert sorted([tuple(r)[:5] for r in got], key=str) == sorted(want, key=str)
    total = sum(w[3] for w in want)
    assert len(by_sequence) <= -(-total // capacity) * 1.25 + 1


def test_packing_of_a_long_text_and_an_empty_table(spark):
    rows = [(1, sentence(random.Random(1), 20_000, 9000)), (2, None)]
    got, _, by_doc = _packed(spark.createDataFrame(rows, "doc_id long, text string"), 2048)
    pieces = sorted(by_doc[1], key=lambda r: r.piece)
    assert len(pieces) > 9 and all(r.length == 2048 for r in pieces[1:]) and [r.start for r in pieces[1:]] == [pieces[0].length + 2048 * i for i in range(len(pieces) - 1)]
    assert [(r.piece, r.length) for r in by_doc[2]] == [(0, 1)]
    assert packing.pack(awkward(spark, []), BYTE, 0).count() == 0


def _simulated(lengths, capacity):
    """Plain best fit of falling lengths, a piece at a time."""
    gaps = []
    for n in sorted(lengths, reverse=True):
        fits = [g for g in gaps if g >= n]
        if fits:
            gaps.remove(min(fits))
            gaps.append(min(fits) - n)
        else:
            gaps.append(capacity - n)
    return len(gaps)


@pytest.mark.parametrize("seed", range(6))
def test_packing_plan_is_best_fit_and_matches_large_pieces(seed):
    rng = random.Random(seed)
    capacity = rng.choice([30, 100, 1000])
    lengths = [rng.choice([rng.randint(1, capacity), rng.randint(capacity // 3, capacity // 2 + 1), rng.randint(1, 1 + capacity // 5)]) for _ in range(400)]
    counts = {n: lengths.count(n) for n in set(lengths)}
    runs = packing.plan(counts, capacity)
    used = defaultdict(list)
    ends = {}
    for length, rank, first, offset in runs[::-1].tolist():
        for r in range(rank, ends.get(length, counts[length])):
            used[first + r - rank].append((offset, length))
        ends[length] = rank
    assert sum(map(len, used.values())) == 400 and len(used) == _simulated(lengths, capacity)
    for pieces in used.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= capacity and sum(3 * n > capacity for _, n in pieces) <= 2


def test_packed_sequences_hold_the_tokens(spark):
    rows = [(i, sentence(random.Random(i), 30 + i, 500)) for i in range(40)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    pieces = packing.cut(frame, BYTE, 0, 512)
    sequences = {r.sequence_id: r.ids for r in packing.sequences(pieces, 512).collect()}
    placed = packing.place(pieces, 512).collect()
    assert all(sequences[r.sequence_id][r.offset:r.offset + r.length] == r.ids for r in placed)
    assert sum(map(len, sequences.values())) == sum(r.length for r in placed)


PAGES = [(1, "http://a/1", "x" * 99), (2, "http://a/2", "x" * 99), (3, "http://a/3", "y" * 100), (4, None, "y" * 100), (5, "http://a/é b\r\nX: y", "é" * 50), (6, "", "é" * 50),
         (7, "u", None), (8, "u", ""), (9, "u", "WARC/1.1\r\n\r\nfoo\r\n\r\n" * 30), (None, "u", "y" * 100), (None, "u", "z" * 200), (3, "http://a/3", "y" * 100),
         (10, "u", "big " * 700_000), (11, "u", "WARC/1.1\r\n\r\nfoo\r\n\r\n" * 30), (-4, "u", "é" * 50)]


def _page_rows(spark, rows=PAGES):
    frame = spark.createDataFrame(rows, "page_id long, url string, html string")
    for name in ("payload", "first", "record_type", "payload_digest", "target_uri"):
        frame = frame.withColumn(name, F.lit("own"))
    return frame


@pytest.mark.parametrize(("compression", "most"), [("none", 1 << 30), ("gzip", 1 << 30), ("gzip", 500), ("none", 500)])
def test_warc_round_trip(spark, tmp_dir, compression, most):
    warc.write_warc(warc.page_records(_page_rows(spark)), f"{tmp_dir}/w", compression, most)
    got = warc.read_warc(spark, f"{tmp_dir}/w").collect()
    first = {}
    for i, _, html in PAGES:
        body = (html or "").encode()
        if len(body) >= 100 and i is not None:
            first[body] = min(i, first.get(body, i))
    want = []
    for i, url, html in PAGES:
        body = (html or "").encode()
        revisit = body in first and first[body] != i
        want.append((f"<urn:page:{'none' if i is None else i}>", "revisit" if revisit else "response", hashlib.sha256(body).hexdigest(), len(body),
                     f"<urn:page:{first[body]}>" if revisit else None, b"" if revisit else body))
    found = [(r.record_id, r.record_type, r.payload_digest, r.payload_bytes, r.refers_to, bytes(r.payload)) for r in got]
    assert sorted(found, key=str) == sorted(want, key=str)
    uris = {r.record_id: r.target_uri for r in got}
    assert uris["<urn:page:4>"] is None and uris["<urn:page:5>"] == "http://a/%C3%A9%20b%0D%0AX:%20y"


@pytest.mark.parametrize("compression", ["none", "gzip"])
def test_warc_pushes_filters_and_skips_payloads(spark, tmp_dir, compression):
    warc.write_warc(warc.page_records(_page_rows(spark)), f"{tmp_dir}/w", compression)
    columns = "record_id string, record_type string, payload_bytes long"
    heads = warc.read_warc(spark, f"{tmp_dir}/w", columns).filter("record_type = 'revisit' AND payload_bytes > 150")
    assert {r.record_id for r in heads.collect()} == {"<urn:page:11>"}
    reader = warc.WarcReader(heads.schema, {"path": f"{tmp_dir}/w"})
    from pyspark.sql.datasource import EqualTo, StringContains

    left = list(reader.pushFilters([EqualTo(("record_type",), "revisit"), StringContains(("record_id",), "1")]))
    assert [type(f).__name__ for f in left] == ["StringContains"]
    reads = []
    rows = []
    for part in reader.partitions():
        for path in part.paths:
            with warc._filesystem(path)[0].open_input_file(path) as f:
                w = warc._Window(f)
                at = w.at
                w.at = lambda pos, n, at=at: reads.append(n) or at(pos, n)
                records = warc._gzip_records if compression == "gzip" else warc._plain_records
                rows += list(records(w, lambda h: h["warc-type"] == "revisit", False))
    assert len(rows) == warc.read_warc(spark, f"{tmp_dir}/w").filter("record_type = 'revisit'").count() > 0
    assert max(reads) <= 1 << 12  # headers only


def test_warc_reads_archives_of_others_and_commits_by_manifest(spark, tmp_dir):
    os.makedirs(f"{tmp_dir}/x")
    record = warc.record_bytes({"record_id": "<urn:page:1>", "record_type": "response", "target_uri": "u", "payload_digest": "d", "payload_bytes": 5, "refers_to": None, "payload": b"hello"})
    other = b"WARC/1.0\r\nWARC-Type: warcinfo\r\nContent-Type: text/plain\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    with open(f"{tmp_dir}/x/a.warc", "wb") as f:
        f.write(other + record)
    with open(f"{tmp_dir}/x/b.warc.gz", "wb") as f:
        f.write(gzip.compress(other) + gzip.compress(record))
    got = warc.read_warc(spark, f"{tmp_dir}/x").collect()
    assert sorted((r.record_type, bytes(r.payload)) for r in got) == [("response", b"hello")] * 2 + [("warcinfo", b"abc")] * 2
    warc.write_warc(warc.page_records(_page_rows(spark, PAGES[:3])), f"{tmp_dir}/y")
    with open(f"{tmp_dir}/y/part-of-a-failed-attempt.warc", "wb") as f:
        f.write(record[:40])
    assert warc.read_warc(spark, f"{tmp_dir}/y").count() == 3
    warc.write_warc(warc.page_records(_page_rows(spark, [])), f"{tmp_dir}/z")
    assert warc.read_warc(spark, f"{tmp_dir}/z").count() == 0


def test_gzip_members_are_readable_by_gzip_and_know_their_length():
    data = os.urandom(1000) * 3
    member = warc.gzip_member(data)
    assert gzip.decompress(member + member) == data * 2 and warc._skip_length(member[:26]) == len(member)
