"""Byte-level BPE ids by the tokenizers library, with each distinct chunk of text merged once per worker.

A chunk is a run of white space and the run of other characters behind it.  The pre-tokenizer of byte-level
files never puts a character that is no white space and a following white-space character into one pre-token,
so a text's ids are its chunks' ids one after the other.  Chunks repeat; the library therefore merges each
distinct chunk once, and texts become a gather over a table of ids.

Common texts are cut as bytes, many at once: chunk borders come from array comparisons, Arrow numbers the distinct
chunks, and only those become Python strings.  There a chunk also ends between a Latin letter and an ASCII mark, which never
share a pre-token; few words with many marks then stay few chunks.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa

from lavra.llm.common import kept, let_go

#: White space as the pre-tokenizer's ``\s`` has it (Unicode's White_Space).
_WS = "\t-\r \x85\xa0  -     　"
_CHUNK = re.compile(f"[{_WS}]*[^{_WS}]+|[{_WS}]+")
#: Characters on which regex libraries disagree whether they are white space.
_UNSURE = re.compile("[\x1c-\x1f\u180e]")
_HIGH_WS = np.array([0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000, 0x180E], np.uint32)
_WS_ANY = re.compile(f"[{_WS}]")
_END_OF_CHUNK = re.compile(f"(?<=[^{_WS}])(?=[{_WS}])")
#: Characters of text handled at once; bounds a worker's memory whatever the length of a text.
WINDOW = 1_000_000
#: Bytes of whole texts whose chunks are numbered at once.
GROUP = 4_000_000
#: What a byte is: 1 white space, 2 an ASCII letter, 4 an ASCII mark.
_KIND = np.array([(c in b"\t\n\x0b\x0c\r ") + 2 * (c < 128 and chr(c).isalpha()) + 4 * (33 <= c < 127 and not chr(c).isalnum()) for c in range(256)], np.uint8)
#: Bytes with which white space above ASCII, or a character of ``_UNSURE``, may begin.
_LEAD = np.isin(np.arange(256), [0x1C, 0x1D, 0x1E, 0x1F, 0xC2, 0xE1, 0xE2, 0xE3])


def spaced(text: str) -> bool:
    """Whether its only white space is single spaces and newlines, each between two other characters."""
    if not text or "  " in text or text[0] in " \n" or text[-1] in " \n":
        return False
    code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    low = code <= 32
    if np.count_nonzero(low) != text.count(" ") + text.count("\n") or bool((low[1:] & low[:-1]).any()):
        return False
    high = code[code >= 0x85]
    return not (high.size and (bool((high <= 0xA0).any()) or bool((high >= 0x1680).any())) and bool(np.isin(high, _HIGH_WS).any()))


def chunks(text: str) -> list[str]:
    """The chunks of ``text``; an empty one stands for a single newline between two others."""
    if spaced(text):
        return text.replace("\n", "\n\n").replace(" ", "\n ").split("\n")
    return _CHUNK.findall(text)


def windows(text: str, size: int = WINDOW) -> Iterator[str]:
    """``text`` in pieces of about ``size`` characters, cut only between chunks."""
    at = 0
    while len(text) - at > size and (cut := _END_OF_CHUNK.search(text, at + size)):
        yield text[at : cut.start()]
        at = cut.start()
    yield text[at:] if at else text


def high_spaces(data: np.ndarray) -> np.ndarray:
    """Places in UTF-8 bytes of white space above ASCII (and a few neighbours), and of characters of ``_UNSURE``."""
    at = np.flatnonzero(_LEAD[data])
    if not at.size:
        return at
    a, b, c = (data[np.minimum(at + k, data.size - 1)] for k in range(3))
    two = (a == 0xC2) & ((b == 0x85) | (b == 0xA0))
    one = (a == 0xE1) & ((b == 0x9A) & (c == 0x80) | (b == 0xA0) & (c == 0x8E))
    general = (a == 0xE2) & ((b == 0x80) & ((c <= 0x8A) | (c >= 0xA8) & (c <= 0xAF)) | (b == 0x81) & (c == 0x9F))
    return at[(a < 0x20) | two | one | general | (a == 0xE3) & (b == 0x80) & (c == 0x80)]


def borders(data: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Where chunks start in texts that lie one after the other, the i-th from ``ends[i]`` to ``ends[i + 1]``.

    White space must be ASCII.  A newline between two other characters is a chunk.
    """
    kind = _KIND[data]
    white = (kind & 1).view(bool)
    starts = np.zeros(data.size + 1, bool)
    starts[ends] = True
    starts[1:-1] |= white[1:] & ~white[:-1]
    lone = data[1:-1] == 10
    lone &= ~white[:-2]
    lone &= ~white[2:]
    starts[2:-1] |= lone
    letter = kind == 2
    letter[1:] |= (data[:-1] == 0xC3) & (data[1:] != 0x97) & (data[1:] != 0xB7)  # two-byte letters but the signs of times and division
    starts[1:-1] |= letter[:-1] & (kind[1:] == 4)
    return np.flatnonzero(starts[:-1])


def chunkable(spec: str) -> bool:
    """Whether a tokenizer file's ids of a text are those of its chunks: byte-level, with nothing that looks across white space."""
    d = json.loads(spec)
    pre = d.get("pre_tokenizer") or {}
    plain = all(not t.get("lstrip") and not t.get("rstrip") and not t.get("single_word") and not _WS_ANY.search(t["content"]) for t in d.get("added_tokens") or [])
    return pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space", True) and pre.get("use_regex", True) and d.get("normalizer") is None and (d.get("model") or {}).get("type") == "BPE" and plain


def special_strings(spec: str) -> list[str]:
    """Strings that the tokenizer takes out of a text before it forms pre-tokens."""
    return sorted({t["content"] for t in json.loads(spec).get("added_tokens") or [] if t["content"]}, key=len, reverse=True)


class ChunkEncoder:
    """Ids of texts.  ``cap`` bounds the table of remembered chunks; others are merged anew in each batch.

    With a file that is not ``chunkable`` the library encodes whole texts.
    """

    def __init__(self, spec: str, cap: int = 700_000) -> None:
        from tokenizers import Tokenizer

        self.tok, self.cap = Tokenizer.from_str(spec), cap
        self.tok.no_truncation()
        self.tok.no_padding()
        self.chunkable = chunkable(spec)
        self.special = [x.encode() for x in special_strings(spec)]
        self.row: dict[str, int] = {}
        self.flat, self.off, self.used = np.empty(1 << 16, np.uint32), np.zeros(1 << 12, np.int64), 0
        newline = self._whole("\n")
        self.newline = newline[0] if len(newline) == 1 else None
        self._add(["", "\n"], [len(newline)] * 2, np.array(newline * 2, np.uint32), keep=True)

    def _whole(self, text: str) -> list[int]:
        return self.tok.encode(text, add_special_tokens=False).ids

    def _add(self, new: list[str], sizes: list[int] | np.ndarray, ids: np.ndarray, keep: bool, behind: int = 0) -> int:
        """Puts rows behind the kept ones; returns the number of the first."""
        first, n = len(self.row) + behind, len(new)
        at = int(self.off[first])
        if at + ids.size > self.flat.size:
            self.flat = np.concatenate([self.flat[:at], np.empty(max(at, ids.size) + ids.size, np.uint32)])
        if first + n + 1 > self.off.size:
            self.off = np.concatenate([self.off[: first + 1], np.empty(2 * (first + n), np.int64)])
        self.flat[at : at + ids.size] = ids
        self.off[first + 1 : first + n + 1] = at + np.cumsum(sizes)
        if keep:
            self.row.update(zip(new, range(first, first + n), strict=True))
        return first

    def merge(self, new: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Number of ids of each chunk, and all ids one after the other, by the library."""
        plain = self.newline is not None and all(not c[0].isspace() or c[0] == " " and not c[1:2].isspace() for c in new)
        if plain:  # one call for all: no chunk holds a newline, so newlines keep them apart
            ids = np.array(self.tok.encode_batch_fast(["\n".join(new)], add_special_tokens=False)[0].ids, np.uint32)
            cuts = np.flatnonzero(ids == self.newline)
            if cuts.size == len(new) - 1:
                return np.diff(np.concatenate([[-1], cuts, [ids.size]])) - 1, np.delete(ids, cuts)
        each = [e.ids for e in self.tok.encode_batch_fast(new, add_special_tokens=False)]
        return np.array([len(e) for e in each], np.int64), np.array([i for e in each for i in e], np.uint32)

    def rows(self, words: list[str]) -> np.ndarray:
        """The number of each chunk's row in the table of ids."""
        got = np.fromiter(map(self.row.get, words, repeat(-1)), np.int64, len(words))
        miss = np.flatnonzero(got < 0)
        if miss.size:
            lost = [words[i] for i in miss.tolist()]
            number = self._learn(list(dict.fromkeys(lost)))
            got[miss] = np.fromiter(map(number.__getitem__, lost), np.int64, len(lost))
            if len(self.row) + len(number) <= self.cap:
                self.row.update(number)
            else:
                self.cap = len(self.row)
        return got

    def _learn(self, new: list[str]) -> dict[str, int]:
        """Rows for chunks that the table lacks.  A letter and a last .,;:!? never share a pre-token, so the mark is set apart."""
        marked = [c for c in new if c[-1] in ".,;:!?" and c[-2:-1].isalpha()]
        bare = dict.fromkeys(c[:-1] for c in marked)
        bare.update(dict.fromkeys(c[-1] for c in marked))
        bare.update(dict.fromkeys(new))
        for c in marked:
            if len(c) > 1:
                del bare[c]
        fresh = [c for c in bare if c not in self.row]
        first = self._add(fresh, *self.merge(fresh), keep=False) if fresh else len(self.row)
        number = dict(zip(fresh, range(first, first + len(fresh)), strict=True))
        if marked:
            pair = np.array([[number.get(x, self.row.get(x)) for x in (c[:-1], c[-1])] for c in marked]).ravel()
            size = self.off[pair + 1] - self.off[pair]
            ids = self._gather(pair)
            first = self._add(marked, size[::2] + size[1::2], ids, keep=False, behind=len(fresh))
            number.update(zip(marked, range(first, first + len(marked)), strict=True))
        return number

    def _batches(self, texts: Iterable[str | None]) -> Iterator[tuple[list[str], list[int]]]:
        """Chunks of some texts and how many each text has, a bounded number at once; -1 ends a text's count early."""
        words: list[str] = []
        counts: list[int] = []
        size = 0
        for text in texts:
            n = 0
            for part in windows(text or ""):
                found = chunks(part)
                words += found
                n += len(found)
                size += len(part)
                if size >= WINDOW:
                    yield words, [*counts, -1 - n]
                    words, counts, n, size = [], [], 0, 0
            counts.append(n)
        yield words, counts

    def _unsure(self, text: str | None) -> bool:
        return bool(text) and (not self.chunkable or bool(_UNSURE.search(text)))

    def encode(self, texts: list[str | None] | pa.Array) -> list[np.ndarray]:
        """Ids of each text as unsigned 32-bit integers; null counts as the empty text."""
        column = (texts if isinstance(texts, pa.Array) else pa.array(texts, pa.large_string())).cast(pa.large_string()).fill_null("")
        if not len(column):
            return []
        _, at, raw = column.buffers()
        ends = np.frombuffer(at, np.int64, len(column) + 1, 8 * column.offset)
        data = np.frombuffer(raw, np.uint8) if raw else np.empty(0, np.uint8)
        out: list[np.ndarray] = []
        first = 0
        while first < len(column):
            last = max(first + 1, int(np.searchsorted(ends, ends[first] + GROUP, side="right")) - 1)
            out += self._group(data[ends[first] : ends[last]], ends[first : last + 1] - ends[first])
            first = last
        return out

    def _group(self, data: np.ndarray, ends: np.ndarray) -> list[np.ndarray]:
        """Ids of texts that lie one after the other; those that need a look at their characters go by themselves."""
        odd = self._odd(data, ends)
        if not odd.any():
            return self._numbered(data, ends)
        own = {i: data[ends[i] : ends[i + 1]] for i in range(odd.size)}
        rest = [own[i] for i in range(odd.size) if not odd[i]]
        easy = iter(self._numbered(np.concatenate(rest), np.concatenate([[0], np.cumsum([x.size for x in rest])])) if rest else [])
        hard = iter(self._each([own[i].tobytes().decode() for i in np.flatnonzero(odd).tolist()]))
        return [next(hard) if x else next(easy) for x in odd.tolist()]

    def _odd(self, data: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Texts that are long or hold special strings, white space above ASCII or unsure characters; all, if not ``chunkable``."""
        odd = np.diff(ends) > WINDOW
        if not self.chunkable:
            odd[:] = True
        if odd.all():
            return odd
        odd[np.searchsorted(ends, high_spaces(data), side="right") - 1] = True
        raw = data.tobytes()
        for special in self.special:
            at = raw.find(special)
            while at >= 0:
                i = int(np.searchsorted(ends, at, side="right")) - 1
                odd[i] = True
                at = raw.find(special, int(ends[i + 1]))
        return odd

    def _numbered(self, data: np.ndarray, ends: np.ndarray) -> list[np.ndarray]:
        """Ids of texts by the numbers that Arrow gives to their distinct chunks."""
        starts = borders(data, ends)
        if not starts.size:
            return [np.empty(0, np.uint32)] * (ends.size - 1)
        offsets = np.append(starts, data.size).astype(np.int32)
        found = pa.StringArray.from_buffers(starts.size, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))).dictionary_encode()
        rows = self.rows(found.dictionary.to_numpy(zero_copy_only=False).tolist())[found.indices.to_numpy()]
        ids = self._gather(rows)
        at = np.concatenate([[0], np.cumsum(self.off[rows + 1] - self.off[rows])])[np.searchsorted(starts, ends)].tolist()
        return [ids[a:b] for a, b in zip(at, at[1:], strict=False)]

    def _each(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text, cut as characters or, where that is not sure, by the library."""
        sure = [None if self._unsure(t) else t for t in texts]
        out = list(self._ids(sure))
        for i, (a, b) in enumerate(zip(texts, sure, strict=True)):
            if a is not b:
                out[i] = np.array(self._whole(a), np.uint32)
        return out

    def _gather(self, rows: np.ndarray) -> np.ndarray:
        start = self.off[rows]
        size = self.off[rows + 1] - start
        end = np.cumsum(size)
        return self.flat[np.arange(end[-1] if end.size else 0) + np.repeat(start - (end - size), size)]

    def _ids(self, texts: list[str | None]) -> Iterator[np.ndarray]:
        """Ids of each text, which may lie in several batches."""
        parts: list[np.ndarray] = []
        for words, counts in self._batches(texts):
            rows = self.rows(words)
            ids = self._gather(rows)
            ends = np.concatenate([[0], np.cumsum(self.off[rows + 1] - self.off[rows])])
            at = 0
            for n in counts:
                stays, n = n < 0, -1 - n if n < 0 else n
                parts.append(ids[ends[at] : ends[at + n]])
                at += n
                if not stays:
                    yield parts[0] if len(parts) == 1 else np.concatenate(parts)
                    parts = []


_ENCODERS: dict[int, ChunkEncoder] = kept()


def encoder(spec: str) -> ChunkEncoder:
    """This worker's encoder for the tokenizer file's content; tasks that follow use it again."""
    key = hash(spec)
    let_go(_ENCODERS)
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = ChunkEncoder(spec)
    return _ENCODERS[key]


def read_spec(path: str) -> str:
    """A tokenizer file's content.  It is about 1.5 MB whatever the corpus, so it may be broadcast."""
    with open(path, encoding="utf-8") as f:
        spec = f.read()
    if len(spec) > 64 << 20:
        raise ValueError(f"{path} holds {len(spec)} characters; a tokenizer file of at most 64 MB is broadcast")
    return spec
