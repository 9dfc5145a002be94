"""Substring deduplication over words by level-wise doubling.

A window is ``window`` consecutive words of one document; each word covered by a window whose word
sequence starts earlier (smaller doc_id, or same document and earlier start) is removed.

Level 1 looks at windows of half the length, and only at those that are the least (by hash, the last
of equals) among the half-windows of some full window. Equal full windows pick equal half-windows at
equal places, so a full window whose half-window occurs once cannot repeat. Consecutive full windows
that pick the same half-window form a chunk. One shuffle by half-window tells
  - chunks whose words all occurred earlier: all their windows are removed,
  - chunks whose half-window occurs with other surroundings: the candidates,
  - the rest, which cannot hold a repeated window.
Level 2 extends the candidates alone to the full length and compares full windows.
:func:`longest_repeats` doubles on (windows repeated at one length alone are extended to twice that
length) until no candidates survive; the removal needs no more than the full length.

Each map block keeps one row of each half-window (or window) for the shuffle, its first; what else
the block holds of it is decided in the block and goes past the shuffle. So a passage that a third of all documents
share sends one row per block, not one per document; if those are many, they are aggregated before the shuffle and
joined back in parts.

Defined results: a null or empty text has no words and stays empty; documents shorter than the
window lose nothing; a row with a null doc_id is returned whole and takes no part; rows that share
doc_id and text are one document and get the same result; rows that share a doc_id but not the text are
documents of their own, in an order that a hash of the text gives. Other columns come back in ``rest``.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Roller, bucketed, carry, discard, live_groups, materialize, materialize_arrow, mix, place, release, ship, signed, sliding_argmin, text_blocks, words_of

_SPACED_WORD = re.compile(rb"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+")
_MARKS = "flag int, a long, c long, multi boolean, twice boolean, doc_id long, pos long, m int"


class _Words:
    """Word hashes of a block, and hashes of word ranges."""

    def __init__(self, buf, off, rollers):
        letters, first, second = rollers
        starts, ends, self.first = words_of(buf, off)
        h = letters.of(letters.prefix(letters.table[buf]), starts, ends)
        self.n = len(h)
        self.doc = np.repeat(np.arange(len(off) - 1), np.diff(self.first))
        self.rollers, self.h = (first, second), h
        self.prefix = first.prefix(h), None

    def hash(self, start, end, which=0):
        if which and self.prefix[1] is None:
            self.prefix = self.prefix[0], self.rollers[1].prefix(mix(self.h + np.uint64(77)))
        return self.rollers[which].of(self.prefix[which], start, end)


def _rollers():
    return Roller(0), Roller(0), Roller(1)


def _chunks(batches: Iterator, window: int) -> Iterator:
    import pyarrow as pa

    half = (window + 1) // 2
    rollers = _rollers()
    for b in batches:
        ids, place = (b.column(i).to_numpy(zero_copy_only=False) for i in (0, 2))
        for lo, _, buf, off in text_blocks(b.column(1)):
            w = _Words(buf, off, rollers)
            if w.n < window:
                continue
            at = np.arange(w.n - half + 1)
            gram = w.hash(at, at + half)
            pick = sliding_argmin(gram, window - half + 1)
            start = np.flatnonzero(w.doc[: w.n - window + 1] == w.doc[window - 1 :])
            if not len(start):
                continue
            pick, doc = pick[start], w.doc[start]
            new = np.flatnonzero(np.concatenate([[True], (pick[1:] != pick[:-1]) | (doc[1:] != doc[:-1])]))
            m = np.diff(np.append(new, len(start)))
            start, doc, a = start[new], doc[new], gram[pick[new]]
            c = w.hash(start, start + m - 1 + window, 1)
            pos = start - w.first[doc] + place[lo + doc]
            doc_id = ids[lo + doc].astype(np.int64)
            # one row of each half-window stays open: its first in this block
            order = np.lexsort((pos, doc_id, a))
            a, c, doc_id, pos, m = a[order], c[order], doc_id[order], pos[order], m[order]
            lead = np.concatenate([[True], a[1:] != a[:-1]])
            group = np.cumsum(lead) - 1
            head = np.flatnonzero(lead)[group]
            same = c == c[head]
            again = same & ((doc_id != doc_id[head]) | (pos != pos[head]))
            twin = same & ~again & ~lead
            flag = np.where(lead | twin, 0, np.where(again, 1, 2)).astype(np.int32)
            multi = np.zeros(group[-1] + 1, bool)
            multi[group[~same]] = True
            yield pa.RecordBatch.from_arrays(
                [pa.array(flag), pa.array(signed(a)), pa.array(signed(c)), pa.array(multi[group]), pa.array(np.zeros(len(a), bool)), pa.array(doc_id), pa.array(pos), pa.array(m.astype(np.int32))],
                ["flag", "a", "c", "multi", "twice", "doc_id", "pos", "m"],
            )


def _spans(column) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Offsets, starts and lengths of an Arrow list<struct<pos, m>> column; null is empty."""
    import pyarrow as pa
    import pyarrow.compute as pc

    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
    flat = column.flatten()
    return np.concatenate([[0], np.cumsum(n)]), flat.field(0).to_numpy(zero_copy_only=False), flat.field(1).to_numpy(zero_copy_only=False)


def _own(so: np.ndarray, sp: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the spans listed for each row: which are of the row's own place, their rows, and their positions without it."""
    row = np.repeat(np.arange(len(place)), np.diff(so))
    keep = (sp >> 32) == (place[row] >> 32)
    return keep, row[keep], sp[keep] & 0xFFFFFFFF


def expand(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """start[i], start[i] + 1, ... (count[i] of them) for each i."""
    total = int(count.sum())
    base = np.repeat(start - np.concatenate([[0], np.cumsum(count)[:-1]]), count)
    return base + np.arange(total)


def _windows(batches: Iterator, window: int) -> Iterator:
    import pyarrow as pa

    rollers = _rollers()
    for b in batches:
        ids, place = (b.column(i).to_numpy(zero_copy_only=False) for i in (0, 2))
        so, sp, sm = _spans(b.column(3))
        keep, row, sp = _own(so, sp, place)
        sm = sm[keep].astype(np.int64)
        for lo, hi, buf, off in text_blocks(b.column(1)):
            w = _Words(buf, off, rollers)
            a, z = np.searchsorted(row, (lo, hi))
            pos, doc = expand(sp[a:z], sm[a:z]), np.repeat(row[a:z] - lo, sm[a:z])
            inside = pos + window <= (w.first[doc + 1] - w.first[doc])
            pos, doc = pos[inside], doc[inside]
            if not len(pos):
                continue
            at = w.first[doc] + pos
            h1, h2 = w.hash(at, at + window), w.hash(at, at + window, 1)
            doc_id, pos = ids[lo + doc].astype(np.int64), pos + place[lo + doc]
            order = np.lexsort((pos, doc_id, h2, h1))
            h1, h2, doc_id, pos = h1[order], h2[order], doc_id[order], pos[order]
            lead = np.concatenate([[True], (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])])
            head = np.flatnonzero(lead)[np.cumsum(lead) - 1]
            flag = ((doc_id != doc_id[head]) | (pos != pos[head])).astype(np.int32)
            shared = np.bincount(np.cumsum(lead) - 1, flag)[np.cumsum(lead) - 1] > 0
            yield pa.RecordBatch.from_arrays(
                [pa.array(flag), pa.array(signed(h1)), pa.array(signed(h2)), pa.array(np.zeros(len(h1), bool)), pa.array(shared), pa.array(doc_id), pa.array(pos)],
                ["flag", "a", "c", "multi", "twice", "doc_id", "pos"],
            )


def _per_document(marks: DataFrame) -> DataFrame:
    return marks.groupBy("doc_id").agg(F.collect_list(F.struct("pos", "m")).alias("spans"))


def _level(text: DataFrame, candidates: DataFrame, window: int, name: str) -> DataFrame:
    """Candidate windows (doc_id, pos, m) at full length: (doc_id, pos, first, repeated) of those that are repeated."""
    joined = text.select("doc_id", "text", place()).join(_per_document(candidates), "doc_id")
    rows = materialize_arrow(joined, f"{name}-rows", lambda batches: _windows(batches, window), "flag int, a long, c long, multi boolean, twice boolean, doc_id long, pos long")
    here, key = F.struct("doc_id", "pos"), F.struct("a", "c")  # both hashes tell windows apart here
    open_rows = rows.where("flag = 0").select(key.alias("a"), F.lit(0).alias("c"), "multi", "twice", "doc_id", "pos")
    live = live_groups(open_rows, f"{name}-live")
    met = live.where((F.col("low") != F.col("high")) | F.col("twice")).select("doc_id", "pos", (here == F.col("low")).alias("first"), F.lit(True).alias("repeated"))
    out = materialize_arrow(met.unionByName(rows.where("flag = 1").select("doc_id", "pos", F.lit(False).alias("first"), F.lit(True).alias("repeated"))), name)
    discard(rows)
    release(text.sparkSession)
    return out


def repeated_windows(text: DataFrame, window: int) -> DataFrame:
    """(doc_id, pos, m): ranges of window starts whose windows occurred earlier. ``text`` is bucketed by doc_id."""
    rows = materialize_arrow(text.where("doc_id IS NOT NULL").select("doc_id", "text", place()), "chunks", lambda b: _chunks(b, window), _MARKS)
    live = live_groups(rows.where("flag = 0").drop("flag"), "live-chunks")
    marks = live.select("doc_id", "pos", "m", F.when(F.struct("doc_id", "pos") != F.col("low"), 1).when(F.col("some"), 2).alias("kind")).where("kind IS NOT NULL")
    # what a block has settled by itself goes past the shuffle
    marks = materialize_arrow(marks.unionByName(rows.where("flag > 0").select("doc_id", "pos", "m", F.col("flag").alias("kind"))), "chunk-marks")
    discard(rows)
    release(text.sparkSession)
    full = _level(text, marks.where("kind = 2"), window, "window-marks")
    return marks.where("kind = 1").select("doc_id", "pos", "m").unionByName(
        full.where("NOT first").select("doc_id", "pos", F.lit(1).alias("m"))
    )


def _remove(batches: Iterator, window: int, verbatim: bool) -> Iterator:
    import pyarrow as pa

    spans_type = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
    for b in batches:
        so, sp, sm = _spans(b.column(3))
        keep, row, sp = _own(so, sp, b.column(2).to_numpy(zero_copy_only=False))
        sm, so = sm[keep], np.searchsorted(row, np.arange(b.num_rows + 1))
        texts, n_words, n_removed, spans = [], [], [], []
        for i, t in enumerate(b.column(1)):
            raw = (t.as_py() or "").encode("utf-8", "surrogatepass")
            words = _SPACED_WORD.findall(raw) if verbatim else raw.split()
            n = len(words)
            runs = []
            if so[i] < so[i + 1]:
                edge = np.zeros(n + 1, np.int64)
                at = np.minimum(sp[so[i] : so[i + 1]], n)
                np.add.at(edge, at, 1)
                np.add.at(edge, np.minimum(at + sm[so[i] : so[i + 1]] - 1 + window, n), -1)
                gone = np.cumsum(edge[:n]) > 0
                words = [x for x, g in zip(words, gone.tolist(), strict=True) if not g]
                turn = np.flatnonzero(np.diff(np.concatenate([[0], gone.view(np.int8), [0]])))
                runs = [{"start": int(x), "end": int(y)} for x, y in turn.reshape(-1, 2)]
            if not verbatim:
                texts.append(b" ".join(words).decode("utf-8", "surrogatepass"))
            else:
                texts.append(t.as_py() if n == len(words) else b"".join(words).decode("utf-8", "surrogatepass"))
            n_words.append(n)
            n_removed.append(n - len(words))
            spans.append(runs)
        yield pa.RecordBatch.from_arrays(
            [b.column(0), pa.array(texts, pa.string()), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(spans, spans_type), *b.columns[4:]],
            ["doc_id", "text", "n_words", "n_removed", "spans", *b.schema.names[4:]],
        )


def substring_dedup(docs: DataFrame, window: int = 20, verbatim: bool = False) -> DataFrame:
    """doc_id, text (what stays), n_words, n_removed, spans (removed runs of words), rest.

    The words that stay are joined by single spaces; with ``verbatim`` each keeps the white space before it,
    and texts that lose nothing are returned as they are, null ones too.
    """
    ship(docs.sparkSession)
    text = bucketed(carry(docs), "texts", "doc_id")
    covered = _per_document(repeated_windows(text, window))
    rest = [c for c in text.columns if c not in ("doc_id", "text")]
    joined = text.join(covered, "doc_id", "left").select("doc_id", "text", place(), "spans", *rest)
    schema = "doc_id long, text string, n_words long, n_removed long, spans array<struct<start:int,end:int>>" + "".join(
        f", rest {text.schema['rest'].dataType.simpleString()}" for _ in rest
    )
    return joined.mapInArrow(lambda b: _remove(b, window, verbatim), schema)


def longest_repeats(docs: DataFrame, window: int = 20) -> DataFrame:
    """(length, windows): how many windows repeat at each length window, 2 * window, ..., until no candidates survive."""
    ship(docs.sparkSession)
    text = bucketed(carry(docs), "texts", "doc_id")
    n = F.size(F.split(F.trim(F.regexp_replace("text", r"[\x20\x09-\x0D]+", " ")), " "))
    candidates = text.where("doc_id IS NOT NULL").select("doc_id", place().alias("pos"), n.alias("m")).where("m > 0")
    out, length = [], window
    while not candidates.isEmpty():
        alive = _level(text, candidates, length, f"level-{length}").where("repeated").select("doc_id", "pos").distinct()
        out.append((length, alive.count()))
        ahead = alive.select("doc_id", (F.col("pos") - length).alias("pos"))
        candidates = materialize(alive.join(ahead, ["doc_id", "pos"]).select("doc_id", "pos", F.lit(1).alias("m")), "candidates")
        length *= 2
    return docs.sparkSession.createDataFrame(out or [(window, 0)], "length int, windows long")


#: The removal over 20 words as DuckDB SQL, for tables whose doc_ids are unique and not null.
SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
starts AS (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS pos FROM d),
windows AS (SELECT doc_id, pos, md5(array_to_string(w[pos:pos + 19], ' ')) AS k FROM starts),
later AS (SELECT doc_id, pos FROM windows QUALIFY row_number() OVER (PARTITION BY k ORDER BY doc_id, pos) > 1),
covered AS (SELECT DISTINCT doc_id, unnest(range(pos, pos + 20)) AS i FROM later),
gone AS (SELECT doc_id, list(i) AS g FROM covered GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(len(g), 0)::BIGINT AS n_removed,
  sha256(array_to_string(CASE WHEN g IS NULL THEN w ELSE list_filter(w, lambda x, i: NOT list_contains(g, i)) END, ' ')) AS kept_sha256
FROM d LEFT JOIN gone USING (doc_id)
"""
