"""SentencePiece ids and texts by a table of distinct chunks.

Spaces become markers and stand at the front of what follows.  Where no piece of a model holds a marker behind another
character, or a newline, and nothing else of it looks across these (``separable`` proves it from the model's own
description), no merge reaches from one chunk (markers or a newline, and the characters behind) into the next: a text's
ids are its chunks' ids one after the other.  Spark counts the distinct chunks of the whole corpus, each is segmented once, and texts become a
gather: ids joined back to the places of their chunks.

The table that workers hold is bounded: at most ``head`` chunks, the most frequent of the corpus, of at most ``LONGEST``
characters.  All other chunks are rare or long, and the library segments them where they stand; a worker remembers some.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator, Sequence
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lavra.llm.common import drop_folder, kept, let_go, materialized, new_folder

MARK = "▁"
#: Longer chunks hardly repeat and are not counted.
LONGEST = 64
#: Chunks in the table: with their ids about 50 bytes each on the driver and in a broadcast.
HEAD = 300_000
#: Characters of a text that are handled at once, rows whose ids are held at once.
WINDOW, ROWS = 1_000_000, 128
#: A text's chunks, each with the blanks (markers) or the newline that it begins with.  The same for Java and Python.
CHUNK = " +[^ \n]*|\n[^ \n]*"
_CHUNK = re.compile(CHUNK)
_EDGE = re.compile("(?<=[^ ])(?= )")
#: Chunks that a worker remembers beyond its table.
LEARNED = 500_000
_NONE = np.zeros(0, np.int64)


def read_model(path: str) -> bytes:
    """A model file's content.  It is about half a megabyte whatever the corpus, so it may be broadcast."""
    with open(path, "rb") as f:
        model = f.read()
    if len(model) > 64 << 20:
        raise ValueError(f"{path} holds {len(model)} bytes; a model of at most 64 MB is broadcast")
    return model


def separable(model: bytes) -> bool:
    """Whether the ids of a text are those of its chunks.

    BPE (its merges depend on their neighbours only) with bytes for unknown characters (unknown ones would join across
    chunks); a normaliser that changes nothing but blanks into markers and the one marker in front; no symbols that are
    looked up before the merges; no piece with a marker behind another character, and none with a newline.
    """
    from sentencepiece import sentencepiece_model_pb2 as pb

    m = pb.ModelProto()
    m.ParseFromString(model)
    n, t = m.normalizer_spec, m.trainer_spec
    plain = n.add_dummy_prefix and not n.remove_extra_whitespaces and n.escape_whitespaces and not n.precompiled_charsmap and not m.denormalizer_spec.precompiled_charsmap
    fixed = any(p.type == pb.ModelProto.SentencePiece.USER_DEFINED for p in m.pieces)
    crossing = any(MARK in p.piece.lstrip(MARK) or "\n" in p.piece for p in m.pieces)
    return t.model_type == pb.TrainerSpec.BPE and t.byte_fallback and not t.treat_whitespace_as_suffix and plain and not fixed and not crossing


def chunks(text: str) -> list[str]:
    """The chunks of a text behind the marker that the library puts in front, as ``CHUNK`` has them."""
    text = " " + text.replace(MARK, " ")
    if "  " not in text and "\x01" not in text:
        return text.replace("\n", "\x01\n").replace(" ", "\x01 ").split("\x01")[1:]
    return _CHUNK.findall(text)


def windows(text: str, size: int) -> Iterator[str]:
    """``text`` in pieces of about ``size`` characters, cut in front of a chunk, whose first blank is left out."""
    at = 0
    while len(text) - at > size and (cut := _EDGE.search(text, at + size)):
        yield text[at : cut.start()]
        at = cut.start() + 1
    yield text[at:] if at else text


class Segmenter:
    """A worker's table of chunks and their ids; the library segments what it lacks."""

    def __init__(self, model: bytes, words: Sequence[str] = (), sizes: np.ndarray = _NONE, ids: np.ndarray = _NONE) -> None:
        import sentencepiece

        self.sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.whole = not separable(model)
        self.row = {w: i for i, w in enumerate(words)}
        self.ids, self.off = ids.astype(np.int32), np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
        #: A piece that stands in front of all but the first window when it is decoded, and how long its text is.
        self.guard = [] if self.whole else self.sp.encode("a")
        self.lone = [] if self.whole else self.sp.encode("a ")[len(self.guard) :]
        self.most = len(self.row) + LEARNED

    def segment(self, words: list[str]) -> list[list[int]]:
        """Ids of each chunk by the library, which puts a marker in front: the chunk's own first one, or one to leave out."""
        got = self.sp.encode([w[1:] if w[0] == " " else w for w in words], num_threads=1)
        return [ids[len(self.lone) :] if w[0] == "\n" else ids if len(w) > 1 else self.lone for w, ids in zip(words, got, strict=True)]

    def _gather(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of chunks one after the other, and where each chunk's end."""
        at = np.fromiter(map(self.row.get, words, repeat(-1)), np.int64, len(words))
        ids, off = self.ids, self.off
        miss = np.flatnonzero(at < 0)
        if miss.size:
            lost = [words[i] for i in miss.tolist()]
            new = list(dict.fromkeys(lost))
            got = self.segment(new)
            number = dict(zip(new, range(len(self.row), len(self.row) + len(new)), strict=True))
            at[miss] = np.fromiter(map(number.__getitem__, lost), np.int64, len(lost))
            off = np.concatenate([off, off[-1] + np.cumsum([len(g) for g in got])])
            ids = np.concatenate([ids, np.fromiter((i for g in got for i in g), np.int32)])
            if len(self.row) + len(new) <= self.most:
                self.row.update(number)
                self.ids, self.off = ids, off
        start = off[at]
        size = off[at + 1] - start
        end = np.cumsum(size)
        return ids[np.arange(end[-1] if end.size else 0) + np.repeat(start - (end - size), size)], end

    def encode_all(self, texts: Sequence[str | None]) -> list[np.ndarray]:
        """All ids of each text; none for null.  Chunks of texts of about ``WINDOW`` characters are joined to their ids at once."""
        if self.whole:
            return [np.array(self.sp.encode(t, num_threads=1) if t else [], np.int32) for t in texts]
        out: list[list[np.ndarray]] = [[] for _ in texts]
        words: list[str] = []
        held: list[tuple[int, int]] = []
        size = 0

        def join() -> None:
            ids, end = self._gather(words)
            at = upto = 0
            for k, n in held:
                last = int(end[upto + n - 1]) if n else at
                out[k].append(ids[at:last])
                at, upto = last, upto + n
            words.clear()
            held.clear()

        for k, text in enumerate(texts):
            for part in self._windows(text) if text else ():
                found = chunks(part)
                words += found
                held.append((k, len(found)))
                size += len(part)
                if size >= WINDOW:
                    join()
                    size = 0
        join()
        return [p[0] if len(p) == 1 else np.concatenate(p) if p else np.zeros(0, np.int32) for p in out]

    def encode(self, text: str | None) -> np.ndarray:
        return self.encode_all([text])[0]

    def _windows(self, text: str) -> Iterator[str]:
        if len(text) <= WINDOW:
            return iter((text,))
        return windows(text.replace(MARK, " "), WINDOW)

    def decode(self, ids: np.ndarray) -> str:
        """The library's text of some ids; a long list in windows that begin where a piece begins with a marker."""
        if self.whole or ids.size <= WINDOW:
            return self.sp.decode(ids.tolist())
        out, at = [], 0
        while at < ids.size:
            end = min(at + WINDOW, ids.size)
            while end < ids.size and not self.sp.id_to_piece(int(ids[end])).startswith(MARK):
                end += 1
            part = ids[at:end].tolist()
            out.append(self.sp.decode(self.guard + part)[1:] if at else self.sp.decode(part))
            at = end
        return "".join(out)


def chunk_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``chunk, n``: how often each chunk of at most ``LONGEST`` characters stands in the whole corpus."""
    text = F.translate(F.col(text_col), MARK, " ")
    found = docs.filter(F.length(text_col) > 0).select(F.explode(F.regexp_extract_all(F.concat(F.lit(" "), text), F.lit(CHUNK), F.lit(0))).alias("chunk"))
    return found.filter(F.length("chunk") <= LONGEST).groupBy("chunk").agg(F.count("*").alias("n"))


def _frequent(counts: DataFrame, most: int) -> DataFrame:
    """The chunks that repeat, down to the frequency at which they are at most ``most``: by a histogram of fixed size."""
    level = F.floor(F.log2("n") * 16)
    sizes = {r["level"]: r["n"] for r in counts.filter("n > 1").groupBy(level.alias("level")).agg(F.count("*").alias("n")).collect()}
    total, least = 0, None
    for at in sorted(sizes, reverse=True):
        total += sizes[at]
        if total > most:
            break
        least = at
    return counts.filter((F.col("n") > 1) & (level >= least)) if least is not None else counts.limit(0)


def chunk_table(docs: DataFrame, model: bytes, text_col: str = "text", head: int = HEAD) -> pa.Table:
    """``chunk, ids``: each of the corpus's most frequent chunks with its ids, segmented once, by tasks; at most ``head`` rows."""
    spark = docs.sparkSession
    folder = new_folder(spark, "chunks")
    counts = materialized(chunk_counts(docs, text_col), "chunks", folder)
    shipped, key = spark.sparkContext.broadcast(model), uuid.uuid4().hex

    def segment(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _segmenter(key, shipped, None)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(own.segment(b.column(0).to_pylist()), pa.list_(pa.int32()))], ["chunk", "ids"])

    table = _frequent(counts, head).select("chunk").mapInArrow(segment, "chunk string, ids array<int>").toArrow()
    drop_folder(spark, folder)
    return table


_SEGMENTERS: dict[str, Segmenter] = kept()


def _segmenter(key: str, model, table) -> Segmenter:
    """This worker's table for a broadcast; tasks that follow use it again."""
    let_go(_SEGMENTERS)
    if key not in _SEGMENTERS:
        _SEGMENTERS.clear()
        _SEGMENTERS[key] = Segmenter(model.value, *(table.value if table else ()))
    return _SEGMENTERS[key]


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", head: int = HEAD, decoded: bool = False) -> DataFrame:
    """``doc_id, ids`` per row, exactly as the library encodes the whole text, without begin or end; also ``decoded``, the
    library's text of these ids, if asked for.

    One pass counts chunks, one gathers; texts never shuffle.  Null is empty text and has no ids; texts of any length are
    encoded whole, in windows; repeated rows and missing ids are rows like others; an empty table gives no rows.  Other
    columns are not read, so their names cannot clash.  With a model that is not ``separable`` the library encodes whole texts.
    """
    spark = docs.sparkSession
    model = read_model(path)
    own = ([], _NONE, _NONE)
    if separable(model):
        table = chunk_table(docs, model, text_col, head).combine_chunks()
        ids = table.column("ids").combine_chunks() if table.num_rows else pa.array([], pa.list_(pa.int32()))
        own = (table.column("chunk").to_pylist(), ids.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64), ids.flatten().to_numpy(zero_copy_only=False))
    shipped, rows, key = spark.sparkContext.broadcast(model), spark.sparkContext.broadcast(own), uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seg = _segmenter(key, shipped, rows)
        for b in batches:
            for at in range(0, b.num_rows, ROWS):
                part = b.slice(at, ROWS)
                got = seg.encode_all(part.column(1).to_pylist())
                sizes = np.concatenate([[0], np.cumsum([g.size for g in got])]).astype(np.int32)
                ids = pa.ListArray.from_arrays(pa.array(sizes), pa.array(np.concatenate(got) if got else np.zeros(0, np.int32)))
                more = [pa.array([seg.decode(g) for g in got], pa.string())] if decoded else []
                yield pa.RecordBatch.from_arrays([part.column(0), ids, *more], ["doc_id", "ids", "decoded"][: 2 + len(more)])

    kind = docs.schema[id_col].dataType.simpleString()
    slim = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return slim.mapInArrow(run, f"doc_id {kind}, ids array<int>" + (", decoded string" if decoded else ""))


def decode(rows: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """``doc_id, text``: the library's text of each list of ids; null and empty lists give the empty text."""
    shipped, key = rows.sparkSession.sparkContext.broadcast(read_model(path)), uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seg = _segmenter(key, shipped, None)
        for b in batches:
            texts = [seg.decode(np.array(x.as_py() or [], np.int32)) for x in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    kind = rows.schema[id_col].dataType.simpleString()
    return rows.select(F.col(id_col).alias("doc_id"), F.col(ids_col).alias("ids")).mapInArrow(run, f"doc_id {kind}, text string")


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` per row: digests of the ids and of the text decoded from them."""
    got = encode(docs, path, decoded=True)
    return got.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256")
    )
