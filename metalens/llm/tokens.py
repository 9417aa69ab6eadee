"""Token ids of whole texts, by a tokenizer file of the tokenizers library.

Most of a corpus repeats a few words, so a worker encodes each distinct chunk
once and looks the others up. A text is cut into chunks only where the
tokenizer's own rules cut as well, so the ids are those of the whole text:

* "spaced" (byte-level BPE, white space goes with what follows it): before a run
  of ASCII white space. Texts with other white space or control characters are
  encoded whole.
* "words" (white space is dropped): before a run of ASCII white space.
* Any other tokenizer encodes whole texts.

Both also cut between plain letters and plain signs, which their rules never put
in one piece. A new chunk of plain letters is one piece, so the model alone gives
its ids; other new chunks are encoded in one call, as one text with an added token
between them: the library takes added tokens out first, so each chunk gets its
own ids. A text that holds the string of an added token is encoded whole, and
gets that token's ids as the library gives them; no text is cut if an added token
has white space in it or takes in what stands beside it.

Cases: an empty text has no ids; nulls must be made empty before; very long texts
are encoded like others, in one slice of their own.
"""

from __future__ import annotations

import json
import os
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from tokenizers import Tokenizer

from .common import worker_local

#: Text encoded at once.
ENCODE_BYTES = 2 << 20
#: Distinct chunks whose ids a worker remembers; beyond, it keeps the half that it met most often.
MEMORY = 600_000

#: White space and control characters that count differently in different libraries, and the two signs among the Latin-1 letters.
_ODD = r"[\x00\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{d7}\x{f7}]"
#: ASCII white space before which each kind of tokenizer cuts.
_SPACES = {"spaced": b" \t\n\f\r", "words": b" \t\n\v\f\r"}
#: Bytes that may be part of what ``_ODD`` finds.
_ODD_BYTES = bytes([0, 0x0B, *range(0x1C, 0x20), 0xC2, 0xE1, 0xE2, 0xE3])
_ODD_AFTER_C3 = bytes([0x97, 0xB7])
#: Letters for which lower case and composition are plain (ASCII, and those that UTF-8 writes with 0xC3), and signs that no rule treats apart.
_LETTERS, _SIGNS = bytes([*range(65, 91), *range(97, 123), 0xC3]), b".,;:!?%#$*&|<>()"
_PIECE = {"spaced": "^ ?[A-Za-zÀ-ÖØ-öø-ÿ]+$", "words": "^[ \\t\\n\\v\\f\\r]*[A-Za-zÀ-ÖØ-öø-ÿ]+$"}

#: Byte-level BPE writes each byte as a character: printable Latin-1 ones as themselves, the others in order from 256.
_PRINTABLE = [*range(33, 127), *range(161, 173), *range(174, 256)]
_BYTE_CHARS = {b: b for b in _PRINTABLE} | {b: 256 + i for i, b in enumerate(x for x in range(256) if x not in _PRINTABLE)}


def _table(members: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(members)] = True
    return out


def added_strings(spec: dict) -> list[str]:
    """Strings that the tokenizer takes out of a text before its other rules."""
    return [t["content"] for t in spec.get("added_tokens") or []]


def chunking_of(spec: dict) -> str | None:
    """How texts may be cut for the tokenizer that ``spec`` describes."""
    pre, norm = spec.get("pre_tokenizer") or {}, spec.get("normalizer")
    if spec.get("post_processor") or spec["model"].get("type") != "BPE" or spec["model"].get("dropout"):
        return None
    if any(t.get(k) for t in spec.get("added_tokens") or [] for k in ("single_word", "lstrip", "rstrip", "normalized")) or any(re.search(r"\s", t) for t in added_strings(spec)):
        return None
    if pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space") and not norm:
        return "spaced"
    steps, norms = pre.get("pretokenizers") or [{}], (norm or {}).get("normalizers") or []
    drops_space = steps[0].get("behavior") == "Removed" and steps[0].get("invert") and steps[0].get("pattern", {}).get("Regex", "").endswith(r"[^\s\p{L}\p{N}]+")
    bytes_after = [s.get("type") for s in steps[1:]] == ["ByteLevel"] and not steps[1].get("add_prefix_space") and not steps[1].get("use_regex")
    if drops_space and bytes_after and [n["type"] for n in norms] == ["NFC", "Replace", "Lowercase"]:
        return "words"
    return None


def separator_of(spec: dict) -> tuple[str, int] | None:
    """(string, id) of an added token that can stand between texts without changing what is found in them."""
    added = added_strings(spec)
    for t in spec.get("added_tokens") or []:
        mark = t["content"]
        joins = (a[-n:] == mark[:n] or mark[-n:] == a[:n] for a in added for n in range(1, min(len(a), len(mark)) + (a != mark)))
        if mark and not any(joins):
            return mark, t["id"]
    return None


def _bytes_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(offsets of the texts, all their bytes)."""
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, np.int32)[texts.offset:texts.offset + len(texts) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return offsets - offsets[0], data[offsets[0]:offsets[-1]]


class Encoder:
    """Encodes many texts with one tokenizer; ``spec`` is the tokenizer file's content."""

    def __init__(self, spec: str, memory: int = MEMORY) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        self.tokenizer = Tokenizer.from_str(spec)
        content = json.loads(spec)
        self.chunking, self.added, self.mark, self.memory = chunking_of(content), added_strings(content), separator_of(content), memory
        self.known: dict[str, int] = {}  # chunk: its number
        self.starts, self.sizes, self.met, self.ids = (np.empty(0, np.int64) for _ in range(4))
        self.ids = self.ids.astype(np.int32)

    def whole(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.int32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _encoded(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids one after another, number of each) of chunks without added tokens."""
        if self.mark is None:
            own = self.whole(chunks)
            return np.concatenate([np.empty(0, np.int32), *own]), np.fromiter(map(len, own), np.int64, len(own))
        mark, mark_id = self.mark
        ids = self.whole([mark.join(chunks) + mark])[0]
        is_mark = ids == mark_id
        return ids[~is_mark], np.diff(np.flatnonzero(is_mark), prepend=-1) - 1

    def _pieces(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The same for chunks that the rules leave in one piece: the model alone decides on them."""
        if self.chunking == "words":
            chunks = [c.strip().lower() for c in chunks]
        tokenize, flat, sizes = self.tokenizer.model.tokenize, [], []
        for piece in "\n".join(chunks).encode().decode("latin-1").translate(_BYTE_CHARS).split(chr(_BYTE_CHARS[10])):
            tokens = tokenize(piece)
            sizes.append(len(tokens))
            flat += [t.id for t in tokens]
        return np.array(flat, np.int32), np.array(sizes, np.int64)

    def _odd(self, texts: pa.Array, offsets: np.ndarray, data: np.ndarray) -> np.ndarray:
        """Numbers of the texts that have to be encoded whole."""
        hits = [np.flatnonzero(_table(_ODD_AFTER_C3)[data[1:]] & (data[:-1] == 0xC3))]
        if self.chunking == "spaced":
            hits.append(np.flatnonzero(_table(_ODD_BYTES)[data]))
        at = np.unique(np.searchsorted(offsets, np.concatenate(hits), side="right") - 1)
        found = pc.match_substring_regex(texts.take(pa.array(at)), _ODD) if len(at) else pa.array([], pa.bool_())
        odd = [at[found.to_numpy(zero_copy_only=False).astype(bool)]]
        odd += [np.flatnonzero(pc.match_substring(texts, t).to_numpy(zero_copy_only=False)) for t in self.added]
        return np.unique(np.concatenate(odd))

    def _numbers(self, chunks: list[str]) -> np.ndarray:
        """The numbers of distinct chunks; new ones are encoded."""
        if len(self.known) > self.memory:
            self._forget()
        numbers = np.fromiter((self.known.get(c, -1) for c in chunks), np.int64, len(chunks))
        new = np.flatnonzero(numbers < 0)
        if len(new):
            fresh = [chunks[i] for i in new.tolist()]
            piece = pc.match_substring_regex(pa.array(fresh), _PIECE[self.chunking]).to_pylist()
            for some, encode in (([c for c, p in zip(fresh, piece, strict=True) if p], self._pieces), ([c for c, p in zip(fresh, piece, strict=True) if not p], self._encoded)):
                if some:
                    ids, sizes = encode(some)
                    self.known.update(zip(some, range(len(self.sizes), len(self.sizes) + len(some)), strict=True))
                    self.starts = np.concatenate((self.starts, len(self.ids) + np.cumsum(sizes) - sizes))
                    self.ids, self.sizes = np.concatenate((self.ids, ids)), np.concatenate((self.sizes, sizes))
                    self.met = np.concatenate((self.met, np.zeros(len(some), np.int64)))
            numbers[new] = [self.known[c] for c in fresh]
        self.met[numbers] += 1
        return numbers

    def _forget(self) -> None:
        kept = np.sort(np.argsort(-self.met, kind="stable")[:self.memory // 2])
        place = np.full(len(self.met), -1)
        place[kept] = np.arange(len(kept))
        self.known = {c: n for c, n in zip(self.known, place[list(self.known.values())].tolist(), strict=True) if n >= 0}
        sizes = self.sizes[kept]
        ends = np.cumsum(sizes)
        self.ids = self.ids[np.repeat(self.starts[kept] - (ends - sizes), sizes) + np.arange(sizes.sum())]
        self.starts, self.sizes, self.met = ends - sizes, sizes, self.met[kept] // 2

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after another, number of ids of each); no nulls in ``texts``."""
        if self.chunking is None:
            own = self.whole(texts.to_pylist())
            return np.concatenate([np.empty(0, np.int32), *own]), np.array([len(x) for x in own], np.int64)
        offsets, data = _bytes_of(texts)
        odd = self._odd(texts, offsets, data)
        if len(odd):  # put in at the end
            whole = self.whole(texts.take(pa.array(odd)).to_pylist())
            is_odd = np.zeros(len(texts), bool)
            is_odd[odd] = True
            texts = pc.if_else(pa.array(is_odd), "", texts)
            offsets, data = _bytes_of(texts)
        space = _table(_SPACES[self.chunking])[data]
        cut = np.concatenate((space[:1], space[1:] & ~space[:-1]))
        letter, sign = _table(_LETTERS)[data], _table(_SIGNS)[data]
        letter[1:] |= data[:-1] == 0xC3
        cut[1:] |= (letter[:-1] & sign[1:]) | (sign[:-1] & letter[1:])
        cut[offsets[:-1][np.diff(offsets) > 0]] = True
        begins = np.flatnonzero(cut)
        ends = np.append(begins, len(data)).astype(np.int32)
        chunks = pa.StringArray.from_buffers(len(begins), pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(data)))
        enc = chunks.dictionary_encode()
        number = self._numbers(enc.dictionary.to_pylist())[enc.indices.to_numpy(zero_copy_only=False)]
        n = self.sizes[number]
        upto = np.concatenate(([0], np.cumsum(n)))
        kind = np.int32 if max(upto[-1], len(self.ids)) < 1 << 31 else np.int64
        out = self.ids[np.repeat((self.starts[number] - upto[:-1]).astype(kind), n) + np.arange(upto[-1], dtype=kind)]
        counts = np.diff(upto[np.searchsorted(begins, offsets)])
        if len(odd):
            sizes = np.array([len(x) for x in whole], np.int64)
            out = np.insert(out, np.repeat(np.cumsum(counts)[odd], sizes), np.concatenate(whole))
            counts[odd] = sizes
        return out, counts


def encoder_for(spec: str) -> Encoder:
    """The worker's encoder; tasks that it runs later go on with what it remembers."""
    return worker_local(f"encoder {hash(spec)}", lambda: Encoder(spec))


def with_end(ids: np.ndarray, counts: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """The same with ``end_id`` after each text's ids."""
    return np.insert(ids, np.cumsum(counts), end_id), counts + 1


def tokenizer_spec(path: str) -> str:
    """A tokenizer file's content, which goes to the tasks (a few MB at most)."""
    with open(path, encoding="utf-8") as f:
        return f.read()
