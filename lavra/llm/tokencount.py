"""Token counts with a shortcut for whole tokens.

``whole_tokens`` proves once, on the driver, which strings of the vocabulary the library encodes as one id when
they stand alone.  A text's pre-tokens are looked up among these and count one each; only the others are merged.  Words
repeat, so a worker remembers what each word with the white space before it (one to a few pre-tokens) came to.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lavra.llm.bpe import chunks, encoder, read_spec, special_strings, windows
from lavra.llm.common import kept, let_go

#: Fixed value: the pattern of byte-level pre-tokenizers.
PRE_TOKEN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")


#: Characters above this one may be letters for one Unicode version and not for another; words with them are merged whole.
LAST_SURE = "\u024f"


def whole_tokens(spec: str) -> list[str]:
    """The vocabulary's strings that are one pre-token and that the library encodes alone as exactly one id.

    At most as many as the vocabulary has entries, so they may be broadcast.
    """
    from tokenizers import Tokenizer

    tok = Tokenizer.from_str(spec)
    ids = list(range(tok.get_vocab_size(with_added_tokens=False)))
    texts = tok.decode_batch([[i] for i in ids], skip_special_tokens=False)
    special = special_strings(spec)
    fit = [(i, t) for i, t in zip(ids, texts, strict=True) if t and "\ufffd" not in t and PRE_TOKEN.findall(t) == [t] and not any(x in t for x in special)]
    got = tok.encode_batch_fast([t for _, t in fit], add_special_tokens=False)
    return [t for (i, t), e in zip(fit, got, strict=True) if e.ids == [i]]


class Counter:
    """Counts of texts by their pre-tokens: one for a proven whole token, else what merging gives.

    ``cap`` bounds what is remembered; beyond it a worker forgets and learns anew.
    """

    def __init__(self, spec: str, whole: list[str], cap: int = 700_000) -> None:
        self.enc, self.whole, self.cap, self.special = encoder(spec), frozenset(whole), cap, special_strings(spec)
        self.known: dict[str, int] = {"": self._learned(["\n"])["\n"]}

    def _learned(self, words: list[str]) -> dict[str, int]:
        """Tokens of each of some chunks."""
        out: dict[str, int] = {}
        parts: dict[str, list[str]] = {}
        for w in words:
            if w in self.whole:
                out[w] = 1
            elif max(w) > LAST_SURE or any(x in w for x in self.special):
                parts[w] = [w]  # the library finds the pre-tokens, and takes special strings out first
            else:
                own = PRE_TOKEN.findall(w)
                lost = [p for p in own if p not in self.whole]
                out[w] = len(own) - len(lost)
                if lost:
                    parts[w] = lost
        rest = list(dict.fromkeys(p for own in parts.values() for p in own))
        if rest:
            sizes, _ = self.enc.merge(rest)
            size = dict(zip(rest, sizes.tolist(), strict=True))
            for w, own in parts.items():
                out[w] = out.get(w, 0) + sum(size[p] for p in own)
        return out

    def count(self, text: str | None) -> int:
        if self.enc._unsure(text):
            return len(self.enc._whole(text))
        total, known = 0, self.known
        for part in windows(text or ""):
            words = chunks(part)
            try:
                total += sum(map(known.__getitem__, words))
            except KeyError:
                lost = [w for w in dict.fromkeys(words) if w not in known]
                if len(known) + len(lost) > self.cap:
                    self.known = known = {"": known[""]}
                    lost = [w for w in dict.fromkeys(words) if w not in known]
                known.update(self._learned(lost))
                total += sum(map(known.__getitem__, words))
        return total


_COUNTERS: dict[int, Counter] = kept()


def count_tokens(docs: DataFrame, path: str, limit: int = 512, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Tokens of every whole text; special strings in texts count as the library's default has them.

    Returns ``doc_id, n_bytes, n_tokens, over_limit`` for each row, repeated rows and null ids included.  Null text is
    empty text with no tokens; texts of any length are counted whole, in windows; an empty table gives no rows.  Other columns are not read, so their names cannot clash.  One narrow pass: no shuffle.
    """
    spark = docs.sparkSession
    spec = read_spec(path)
    shipped = spark.sparkContext.broadcast((spec, whole_tokens(spec)))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spec, whole = shipped.value
        key = hash(spec)
        let_go(_COUNTERS)
        if key not in _COUNTERS:
            _COUNTERS.clear()
            _COUNTERS[key] = Counter(spec, whole)
        counter = _COUNTERS[key]
        for b in batches:
            n = [counter.count(t.as_py()) for t in b.column(2)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(n, pa.int64()), pa.array([x > limit for x in n])], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    text = F.coalesce(F.col(text_col), F.lit(""))
    slim = docs.select(F.col(id_col).alias("doc_id"), F.octet_length(text).cast("long").alias("n_bytes"), text.alias("text"))
    return slim.mapInArrow(count, f"doc_id {docs.schema[id_col].dataType.simpleString()}, n_bytes long, n_tokens long, over_limit boolean")
