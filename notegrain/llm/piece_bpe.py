"""SentencePiece encoding and decoding of merge-type (BPE) vocabularies.

Blanks are written as U+2581 in pieces, and a text gets one more in front. It is cut before each run of blanks and at
other places that no piece of the vocabulary reaches across, so merges never cross and each segment is encoded alone.

A segment starts as its characters. The agenda holds every adjacent pair that spells a piece, ordered by score (higher
first) and then by position (left first); the first pair is merged and its two new neighbours enter the agenda, until
the agenda is empty. ``agenda_encode`` does this with a heap. ``MergeVocabulary.encode_segments`` runs the same agenda
for thousands of segments at once as numpy rounds. Characters without a piece become byte pieces.

Segments recur, so their results are kept in a table per worker, bounded by entries and by characters; long ones, which
seldom recur, are kept only while their batch lasts. Every text is encoded whole by the sentencepiece library as well, and
a difference raises; the ids are then decoded by the library's decode, which must spell what the segments' ids do. Texts
that recur in a batch go through all this once.

Defined results: a null or empty text has no ids (n_tokens 0) and decodes to the empty text; rows are independent, so
repeated rows and ties give repeated results; an empty table gives an empty table; very long texts and segments take
time in proportion (n log n for one segment).
"""

from __future__ import annotations

import hashlib
import heapq
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from notegrain.llm._common import id_and_text, pieces, table

MARK = "▁"
#: Segments of more symbols than this go through the heap.
WIDE = 40
#: Entries, and characters in them, that a worker keeps before it starts anew.
KEPT_SEGMENTS, KEPT_CHARACTERS = 300_000, 4_000_000
_PAIR = 1 << 21
_NONE = np.int32(-(1 << 30))
_LAST = np.int32((1 << 31) - 1)


class MergeVocabulary:
    """Pieces, scores and merges of a model, read from its serialised form."""

    def __init__(self, model: bytes):
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_proto=model)
        size = self.library.vocab_size()
        self.pieces = [self.library.id_to_piece(i) for i in range(size)]
        special = [self.library.is_control(i) or self.library.is_unknown(i) or self.library.is_byte(i) for i in range(size)]
        self.unknown = self.library.unk_id()
        self.byte_id = {int(p[3:5], 16): i for i, p in enumerate(self.pieces) if self.library.is_byte(i)}
        self.id_byte = {i: b for b, i in self.byte_id.items()}
        self.control = {i for i in range(size) if self.library.is_control(i)}
        self.text_id = {p: i for i, p in enumerate(self.pieces) if not special[i]}
        scores = np.full(size, -np.inf)
        for p, i in self.text_id.items():
            scores[i] = self.library.get_score(i)
        if any(MARK in p.lstrip(MARK) for p in self.text_id):
            raise ValueError("a piece holds the blank's mark after another character")
        # characters that only occur inside longer pieces still need a symbol to merge from
        self.symbol = {p: i for p, i in self.text_id.items() if len(p) == 1}
        for p in self.text_id:
            for c in p:
                self.symbol.setdefault(c, size + len(self.symbol))
        self.size = size
        known = self.text_id | {c: i for c, i in self.symbol.items() if i >= size}
        self.merges = {(known[p[:k]], known[p[k:]]): i for p, i in self.text_id.items() for k in range(1, len(p)) if p[:k] in known and p[k:] in known}
        self.scores = scores
        self._order = np.unique(-scores, return_inverse=True)[1].astype(np.int32)
        self._plain: list = [None if special[i] else p.replace(MARK, " ") for i, p in enumerate(self.pieces)]
        self._cut = self._cutter()
        self.char = {i: c for c, i in self.symbol.items()}
        keys = np.array([a * _PAIR + b for a, b in self.merges] or [-1], np.int64)
        order = np.argsort(keys)
        self._keys, self._merged = keys[order], np.array(list(self.merges.values()) or [-1], np.int32)[order]
        self._points = -np.arange(0x110000, dtype=np.int32) - 1
        for c, i in self.symbol.items():
            self._points[ord(c)] = i
        self._points[ord(" ")] = self._points[ord(MARK)]

    def _cutter(self) -> re.Pattern:
        """Matches one segment after another; blanks stand for marks.

        A segment is a run of blanks and what follows up to the next. Shorter ones recur more often, so it is also cut
        where no piece could reach across: around ASCII characters without a piece (line ends), and between a letter
        and an ASCII mark that follows no letter in any piece.
        """
        joined = {c for p in self.text_id for a, c in zip(p, p[1:], strict=False) if a.isalpha()}
        alone = "".join(re.escape(chr(k)) for k in range(128) if chr(k) not in self.symbol and chr(k) != " ")
        marks = "".join(re.escape(chr(k)) for k in range(33, 127) if not chr(k).isalnum() and chr(k) not in joined | {"_"})
        alone, marks = alone or "\0", marks or "\0"
        return re.compile(rf" *[^\W\d_]+(?=[{marks}])|[{alone}]| +[^ {alone}]*|[^ {alone}]+")

    def segments(self, text: str) -> list[str]:
        """A text's segments with blanks for marks; joined they are the text with one blank in front."""
        return self._cut.findall(" " + text.replace(MARK, " ")) if text else []

    def _ids(self, symbol: int) -> list[int]:
        """A final symbol's ids: its own, or its character's bytes."""
        if 0 <= symbol < self.size:
            return [symbol]
        c = self.char[symbol] if symbol >= 0 else chr(-symbol - 1)
        return [self.byte_id[b] for b in c.encode()] if self.byte_id else [self.unknown]

    def agenda_encode(self, segment: str) -> list[int]:
        """Ids of one segment by a heap of adjacent pairs; n log n."""
        symbols = self._points[[ord(c) for c in segment]].tolist()
        left, right = list(range(-1, len(symbols) - 1)), [*range(1, len(symbols)), -1]
        agenda: list[tuple[float, int, int, int, int]] = []

        def offer(i: int, j: int) -> None:
            merged = self.merges.get((symbols[i], symbols[j])) if i >= 0 and j >= 0 else None
            if merged is not None:
                heapq.heappush(agenda, (-self.scores[merged], i, symbols[i], symbols[j], merged))

        for i in range(len(symbols) - 1):
            offer(i, i + 1)
        gone = [False] * len(symbols)
        while agenda:
            _, i, a, b, merged = heapq.heappop(agenda)
            j = right[i]
            if gone[i] or j < 0 or symbols[i] != a or symbols[j] != b:
                continue  # one of the two has been merged meanwhile
            symbols[i], gone[j], right[i] = merged, True, right[j]
            if right[j] >= 0:
                left[right[j]] = i
            offer(left[i], i)
            offer(i, right[i])
        return [x for s, dead in zip(symbols, gone, strict=True) if not dead for x in self._ids(s)]

    def _pair(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Merged ids of pairs, -1 where they spell no piece."""
        key = a.astype(np.int64) * _PAIR + b
        at = np.minimum(np.searchsorted(self._keys, key), len(self._keys) - 1)
        return np.where((self._keys[at] == key) & (a >= 0) & (b >= 0), self._merged[at], np.int32(-1))

    def _rank(self, merged: np.ndarray) -> np.ndarray:
        """Place in the order of scores; equal only for the same piece."""
        return np.where(merged >= 0, self._order[merged], _LAST)

    def _rounds(self, symbols: np.ndarray) -> np.ndarray:
        """The agenda of each row of a matrix (padded with _NONE); a round merges each row's first pair."""
        n, width = symbols.shape
        out, rows, columns = symbols.copy(), np.arange(n), np.arange(width)
        merged = np.full((n, width), np.int32(-1))
        merged[:, :-1] = self._pair(symbols[:, :-1], symbols[:, 1:])
        rank = self._rank(merged)
        while True:
            best = rank.argmin(1)
            live = rank[np.arange(len(rows)), best] < _LAST
            if not live.all():
                out[rows[~live]] = symbols[~live]
                rows, symbols, merged, rank, best = rows[live], symbols[live], merged[live], rank[live], best[live]
                if not len(rows):
                    return out
            every = np.arange(len(rows))
            symbols[every, best] = merged[every, best]
            shift = np.minimum(columns + (columns > best[:, None]), width - 1)
            symbols, merged, rank = (np.take_along_axis(x, shift, 1) for x in (symbols, merged, rank))
            symbols[:, -1], merged[:, -1], rank[:, -1] = _NONE, -1, _LAST
            for at in (best - 1, best):
                ok = (at >= 0) & (at < width - 1)
                r, c = every[ok], at[ok]
                # what stood at best after the shift belongs to the pair (merged, next)
                merged[r, c] = self._pair(symbols[r, c], symbols[r, c + 1])
                rank[r, c] = self._rank(merged[r, c])

    def encode_segments(self, segments: list[str]) -> list[list[int]]:
        """Ids of many segments; the same as agenda_encode of each."""
        out: list[list[int]] = [[]] * len(segments)
        lengths = np.fromiter(map(len, segments), np.int64, len(segments))
        for width in (2, 4, 6, 8, 10, 12, 16, 24, WIDE):
            low = {2: 0, 4: 2, 6: 4, 8: 6, 10: 8, 12: 10, 16: 12, 24: 16, WIDE: 24}[width]
            chosen = np.flatnonzero((lengths > low) & (lengths <= width))
            if not len(chosen):
                continue
            points = np.frombuffer("".join([segments[i] for i in chosen]).encode("utf-32-le"), np.uint32)
            matrix = np.full((len(chosen), width), _NONE)
            matrix[np.arange(width) < lengths[chosen, None]] = self._points[points]
            done = self._rounds(matrix)
            plain = ((done == _NONE) | ((done >= 0) & (done < self.size))).all(1)
            counts = (done != _NONE).sum(1)
            for i, row, k, ok in zip(chosen.tolist(), done.tolist(), counts.tolist(), plain.tolist(), strict=True):
                out[i] = row[:k] if ok else [x for s in row[:k] for x in self._ids(s)]
        for i in np.flatnonzero(lengths > WIDE):
            out[i] = self.agenda_encode(segments[i])
        return out

    def encode(self, text: str | None) -> list[int]:
        return [x for ids in self.encode_segments(self.segments(text or "")) for x in ids]

    def _spell(self, ids: list[int]) -> str:
        """Pieces joined, marks as blanks; runs of byte pieces are UTF-8, bad bytes U+FFFD each."""
        parts: list[str] = []
        run = bytearray()

        def flush() -> None:
            if run:
                parts.append(_utf8(bytes(run)))
                run.clear()

        for i in ids:
            if i in self.id_byte:
                run.append(self.id_byte[i])
                continue
            flush()
            if i == self.unknown:
                parts.append(" ⁇ ")
            elif i not in self.control:
                parts.append(self.pieces[i].replace(MARK, " "))
        flush()
        return "".join(parts)

    def spell(self, ids: list[int]) -> str:
        """Pieces joined, blanks for marks; byte pieces, controls and the unknown go the long way."""
        try:
            return "".join([self._plain[i] for i in ids])
        except TypeError:
            return self._spell(ids)

    def decode(self, ids: list[int]) -> str:
        """Text of ids; the blank put in front by encoding is taken off."""
        first = next((i for i in ids if i not in self.control), None)
        text = self._spell(ids)
        return text[1:] if first is not None and self.pieces[first].startswith(MARK) else text


def _utf8(data: bytes) -> str:
    out, at = [], 0
    while at < len(data):
        try:
            out.append(data[at:].decode())
            break
        except UnicodeDecodeError as e:
            out.append(data[at : at + e.start].decode() + "�")
            at += e.start + 1
    return "".join(out)


class SegmentTable:
    """Ids (as text) of the segments a worker has met; bounded.

    A segment that doesn't decode to itself is noted in odd with what it decodes to.
    """

    def __init__(self, vocabulary: MergeVocabulary, most: int = KEPT_SEGMENTS, characters: int = KEPT_CHARACTERS):
        self.vocabulary, self.most, self.characters = vocabulary, most, characters
        self.ids: dict[str, str] = {}
        self.odd: dict[str, str] = {}
        self.held = 0
        self.passing: list[str] = []
        self._digits = [str(i) for i in range(vocabulary.size)]

    def learn(self, segments: set[str]) -> None:
        """Make sure of the segments of a batch."""
        for s in self.passing:  # the last batch's long ones
            del self.ids[s]
            self.odd.pop(s, None)
        fresh = [s for s in segments if s not in self.ids]
        size = sum(map(len, fresh))
        if len(self.ids) + len(fresh) > self.most or self.held + size > self.characters:
            self.ids, self.odd, self.held, fresh = {}, {}, 0, list(segments)
        self.passing = [s for s in fresh if len(s) > WIDE]
        self.held += sum(map(len, fresh)) - sum(map(len, self.passing))
        digits, spell = self._digits, self.vocabulary.spell
        for s, ids in zip(fresh, self.vocabulary.encode_segments(fresh), strict=True):
            self.ids[s] = ",".join([digits[i] for i in ids])
            if spell(ids) != s:
                self.odd[s] = spell(ids)

    def decoded(self, segments: list[str]) -> str:
        """What the segments' ids decode to."""
        return "".join([self.odd.get(s, s) for s in segments] if self.odd else segments)[1:]

    def verified(self, text: str, segments: list[str]) -> tuple[str, str]:
        """Ids (as text) of a whole text and what the library decodes them to; raises where the library differs, either way."""
        library, ids = self.vocabulary.library, ",".join(map(self.ids.__getitem__, segments))
        theirs = library.encode(text, num_threads=1)
        if ",".join(map(self._digits.__getitem__, theirs)) != ids:
            raise AssertionError(f"the library encodes {text[:80]!r}... otherwise")
        back = library.decode(theirs, num_threads=1)  # theirs are the ids, as has just been seen
        if back != self.decoded(segments):
            raise AssertionError(f"the library decodes {text[:80]!r}... otherwise")
        return ids, back


_TABLES: dict[str, SegmentTable] = {}


def _segment_table(model: bytes) -> SegmentTable:
    name = hashlib.sha256(model).hexdigest()
    if name not in _TABLES:
        _TABLES[name] = SegmentTable(MergeVocabulary(model))
    return _TABLES[name]


def encode_batch(known: SegmentTable, texts: list[str | None]) -> Iterator[tuple[str, str]]:
    """(ids joined by commas, decoded text) for each text; every text is verified whole."""
    cut = {t: known.vocabulary.segments(t) for t in {t or "": None for t in texts}}
    known.learn({s for segments in cut.values() for s in segments})
    done: dict[str, tuple[str, str]] = {}
    for text in (t or "" for t in texts):
        if text not in done:
            done[text] = known.verified(text, cut[text])
        yield done[text]


def piece_codec(docs: DataFrame, model: bytes, keep_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 (with keep_ids also ids, an array) of every text.

    The model's bytes (bounded: half a megabyte for 32,000 pieces) travel with the tasks, so executors need no file.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)
    fields = [("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())]
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    if keep_ids:
        fields, schema = [*fields, ("ids", pa.list_(pa.int32()))], schema + ", ids array<int>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _segment_table(shared.value)
        for batch in pieces(batches):
            counts, ids_hash, text_hash, all_ids = [], [], [], []
            for ids, text in encode_batch(known, batch.column(1).to_pylist()):
                counts.append(ids.count(",") + 1 if ids else 0)
                ids_hash.append(hashlib.sha256(ids.encode()).hexdigest())
                text_hash.append(hashlib.sha256(text.encode()).hexdigest())
                if keep_ids:
                    all_ids.append(np.array(ids.split(",") if ids else [], np.int32))
            columns = [batch.column(0), counts, ids_hash, text_hash, *([all_ids] if keep_ids else [])]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(columns, fields, strict=True)], [n for n, _ in fields])

    return id_and_text(docs).mapInArrow(run, schema)


def model_bytes(path: str | None = None) -> bytes:
    """The model's file; by default the public 32k model."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("piece_bpe_32k.model")
    with open(path, "rb") as f:
        return f.read()


def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """piece_codec of the whole documents table; see the module for nulls, repeated rows and empty tables."""
    return piece_codec(table(spark, sf_dir, "documents"), model_bytes())
