"""Byte-substring deduplication over a content-triggered parse of the corpus.

A string of ``length`` bytes of one document that also starts anywhere else is repeated; each byte
covered by one is removed, all copies alike.

The rolling hash of ``gram`` bytes triggers phrases: a trigger is the place with the least hash
among the grams of some window of ``length`` bytes (the last of equals), so each window has exactly
one, and equal windows have it at the same distance. The consecutive windows of one trigger are a
phrase; its dictionary entry is the text that they cover. One shuffle by trigger tells phrases that
occur whole elsewhere (all their windows are repeated), phrases whose trigger occurs with other
surroundings (the candidates), and the rest, where nothing repeats.

A candidate is repeated in part at most: around its trigger it agrees with others to some distance
on either side. Its windows are dealt into bins by distance from the trigger, ``steps[0]`` to a bin,
and compared by the text common to the whole bin: bins that occur whole elsewhere are repeated, bins
whose common text occurs nowhere else hold nothing, the rest go into bins of ``steps[1]`` windows,
and so on to single windows. So only the windows next to both ends of a repeat are ever compared one
by one, and few rows are shuffled for each repeat.

Each map block sends one row of each key, its first, and settles the others itself: a passage that a
third of all documents share sends one row per block; if those are many, they are aggregated before the shuffle.

Defined results: a null text is empty and loses nothing; texts shorter than ``length`` lose nothing;
a row with a null doc_id is returned whole and takes no part; rows that share doc_id and text are one
document; rows that share a doc_id but not the text are documents of their own. Removal may cut
a character, so what is kept is binary. Other columns come back in ``rest``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Roller, bucketed, carry, discard, live_groups, materialize_arrow, mix, place, release, ship, signed, sliding_argmin, text_blocks
from .substring_dedup import _own, expand

BLOCK = 1_000_000
_ROWS = "flag int, a long, c long, multi boolean, twice boolean, doc_id long, pos long, m int, anc int"


def _settle(a, c, doc_id, pos, m, anc):
    """Sort a block's rows by key; leave the first of each key open (flag 0), mark what repeats it (1) and what differs (2)."""
    import pyarrow as pa

    order = np.lexsort((pos, doc_id, a))
    a, c, doc_id, pos, m, anc = (x[order] for x in (a, c, doc_id, pos, m, anc))
    lead = np.concatenate([[True], a[1:] != a[:-1]])
    group = np.cumsum(lead) - 1
    head = np.flatnonzero(lead)[group]
    same = c == c[head]
    other = (doc_id != doc_id[head]) | (pos != pos[head])
    again = same & other
    flag = np.where(again, 1, np.where(same, 0, 2)).astype(np.int32)
    multi = np.bincount(group, ~same)[group] > 0
    twice = np.bincount(group, again)[group] > 0
    return pa.RecordBatch.from_arrays(
        [pa.array(flag), pa.array(signed(a)), pa.array(signed(c)), pa.array(multi), pa.array(twice), pa.array(doc_id), pa.array(pos), *(pa.array(x.astype(np.int32)) for x in (m, anc))],
        ["flag", "a", "c", "multi", "twice", "doc_id", "pos", "m", "anc"],
    )


def _phrases(batches: Iterator, length: int, gram: int) -> Iterator:
    first, second = Roller(0), Roller(1)
    for b in batches:
        ids, place = (b.column(i).to_numpy(zero_copy_only=False) for i in (0, 2))
        for lo, _, buf, off in text_blocks(b.column(1), BLOCK):
            n = len(buf)
            if n < length:
                continue
            p = first.prefix(first.table[buf])
            at = np.arange(n - gram + 1)
            grams = first.of(p, at, at + gram)
            pick = sliding_argmin(grams, length - gram + 1)
            size = np.diff(off)
            doc = np.flatnonzero(size >= length)
            if not len(doc):
                continue
            count = size[doc] - length + 1
            start, doc = expand(off[doc], count), np.repeat(doc, count)
            pick = pick[start]
            new = np.flatnonzero(np.concatenate([[True], (pick[1:] != pick[:-1]) | (doc[1:] != doc[:-1])]))
            m = np.diff(np.append(new, len(start)))
            start, doc, pick = start[new], doc[new], pick[new]
            q = second.prefix(second.table[buf])
            c = second.of(q, start, start + m - 1 + length)
            yield _settle(grams[pick], c, ids[lo + doc].astype(np.int64), start - off[doc] + place[lo + doc], m, pick - off[doc])


def _triples(column):
    import pyarrow as pa
    import pyarrow.compute as pc

    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
    flat = column.flatten()
    return np.concatenate([[0], np.cumsum(n)]), *(flat.field(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(flat.type.num_fields))


def _bins(batches: Iterator, length: int, step: int) -> Iterator:
    first, second = Roller(0), Roller(1)
    for b in batches:
        ids, place = (b.column(i).to_numpy(zero_copy_only=False) for i in (0, 2))
        so, sp, sm, sa = _triples(b.column(3))
        keep, row, sp = _own(so, sp, place)
        sm, sa = sm[keep], sa[keep]
        for lo, hi, buf, off in text_blocks(b.column(1), BLOCK):
            x, z = np.searchsorted(row, (lo, hi))
            pos, m, anc, doc = sp[x:z], sm[x:z], sa[x:z], row[x:z] - lo
            inside = pos + m - 1 + length <= off[doc + 1] - off[doc]
            doc, pos, m, anc = doc[inside], pos[inside], m[inside], anc[inside]
            if not len(pos):
                continue
            least, most = anc - pos - m + 1, anc - pos  # distances of the trigger from the window starts
            j0 = least // step
            count = most // step - j0 + 1
            j = expand(j0, count)
            doc, anc, least, most = (np.repeat(v, count) for v in (doc, anc, least, most))
            least, most = np.maximum(least, j * step), np.minimum(most, j * step + step - 1)
            base = off[doc]
            start, m = base + anc - most, most - least + 1
            p, q = first.prefix(first.table[buf]), second.prefix(second.table[buf])
            core = base + anc - j * step
            a = mix(first.of(p, core, core - (step - 1) + length) + j.astype(np.uint64) * np.uint64(step > 1))
            yield _settle(a, second.of(q, start, start + m - 1 + length), ids[lo + doc].astype(np.int64), start - base + place[lo + doc], m, anc)


def _judge(text: DataFrame, step: Callable[[Iterator], Iterator], name: str) -> DataFrame:
    """(doc_id, pos, m, anc, repeated, next) of the rows that ``step`` makes of ``text``: ``next`` rows go to the next level, as
    candidates or as the one witness of rows that are repeated whole while others have the same key."""
    rows = materialize_arrow(text, f"{name}-rows", step, _ROWS)
    what = ("doc_id", "pos", "m", "anc")
    live = live_groups(rows.where("flag = 0").drop("flag"), f"{name}-live")
    met = live.select(
        *what, (F.col("twice") | (F.col("low") != F.col("high"))).alias("repeated"), (F.col("some") & (F.col("low") == F.struct("doc_id", "pos"))).alias("next")
    )
    # what a block has settled by itself goes past the shuffle
    out = materialize_arrow(met.unionByName(rows.where("flag > 0").select(*what, (F.col("flag") == 1).alias("repeated"), (F.col("flag") == 2).alias("next"))).where("repeated OR next"), name)
    discard(rows)
    return out


def repeated_strings(text: DataFrame, length: int, gram: int = 64, steps: tuple[int, ...] = (48, 6, 1)) -> DataFrame:
    """(doc_id, pos, m): ranges of starts of repeated strings. ``text`` is bucketed by doc_id."""
    if steps[-1] != 1:
        raise ValueError("the last step must be 1")
    gram = min(gram, length)
    steps = tuple(s for s in steps if s <= length)
    marks = _judge(text.where("doc_id IS NOT NULL").select("doc_id", "text", place()), lambda b: _phrases(b, length, gram), "phrases")
    out = marks.where("repeated").select("doc_id", "pos", "m")
    for step in steps:
        spans = marks.where("next").groupBy("doc_id").agg(F.collect_list(F.struct("pos", "m", "anc")).alias("spans"))
        joined = text.select("doc_id", "text", place()).join(spans, "doc_id")
        marks = _judge(joined, lambda b, s=step: _bins(b, length, s), f"bins-{step}")
        release(text.sparkSession)
        out = out.unionByName(marks.where("repeated").select("doc_id", "pos", "m"))
    return out


def prefix_free_figures(docs: DataFrame, gram: int = 16, modulus: int = 64) -> DataFrame:
    """(corpus_bytes, phrases, distinct, dictionary_bytes) of a prefix-free parse with triggers where a rolling hash is 0
    modulo ``modulus``: what suffix arrays of dictionary and parse would have to hold. Not used by the removal."""
    import pyarrow as pa

    ship(docs.sparkSession)

    def run(batches: Iterator) -> Iterator:
        roll = Roller(0)
        for b in batches:
            for _, _, buf, off in text_blocks(b.column(0), BLOCK):
                if not len(buf):
                    continue
                p = roll.prefix(roll.table[buf])
                at = np.arange(max(0, len(buf) - gram + 1))
                hit = np.flatnonzero(roll.of(p, at, at + gram) % np.uint64(modulus) == 0)
                doc = np.searchsorted(off, hit, "right") - 1
                hit = hit[hit + gram <= off[doc + 1]]
                start = np.union1d(hit, off[:-1][np.diff(off) > 0])
                last = np.searchsorted(off, start, "right")  # of each phrase's document, the end
                end = np.minimum(np.append(start[1:], len(buf)) + gram, off[last])
                yield pa.RecordBatch.from_arrays([pa.array(signed(roll.of(p, start, end))), pa.array((end - start).astype(np.int64)), pa.array(np.minimum(np.append(start[1:], len(buf)), off[last]) - start)], ["h", "size", "step"])

    phrases = docs.select(F.col("text").cast("string")).mapInArrow(run, "h long, size long, step long").groupBy("h").agg(F.count("*").alias("n"), F.max("size").alias("size"), F.sum("step").alias("step"))
    return phrases.agg(F.sum("step").alias("corpus_bytes"), F.sum("n").alias("phrases"), F.count("*").alias("distinct"), F.sum("size").alias("dictionary_bytes"))


def _remove(batches: Iterator, length: int) -> Iterator:
    import pyarrow as pa

    spans_type = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
    for b in batches:
        so, sp, sm = _triples(b.column(3))
        keep, row, sp = _own(so, sp, b.column(2).to_numpy(zero_copy_only=False))
        sm, so = sm[keep], np.searchsorted(row, np.arange(b.num_rows + 1))
        kept, n_bytes, n_removed, spans = [], [], [], []
        for i, t in enumerate(b.column(1)):
            raw = (t.as_py() or "").encode("utf-8", "surrogatepass")
            n, runs = len(raw), []
            if so[i] < so[i + 1]:
                at, m = sp[so[i] : so[i + 1]], sm[so[i] : so[i + 1]]
                edge = np.zeros(n + 1, np.int64)
                np.add.at(edge, np.minimum(at, n), 1)
                np.add.at(edge, np.minimum(at + m - 1 + length, n), -1)
                gone = np.cumsum(edge[:n]) > 0
                turn = np.flatnonzero(np.diff(np.concatenate([[0], gone.view(np.int8), [0]])))
                runs = [{"start": int(x), "end": int(y)} for x, y in turn.reshape(-1, 2)]
                raw = np.frombuffer(raw, np.uint8)[~gone].tobytes()
            kept.append(raw)
            n_bytes.append(n)
            n_removed.append(n - len(raw))
            spans.append(runs)
        yield pa.RecordBatch.from_arrays(
            [b.column(0), pa.array(kept, pa.binary()), pa.array(n_bytes, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(spans, spans_type), *b.columns[4:]],
            ["doc_id", "kept", "n_bytes", "n_removed", "spans", *b.schema.names[4:]],
        )


def suffix_dedup(docs: DataFrame, length: int = 400) -> DataFrame:
    """doc_id, kept (bytes), n_bytes, n_removed, spans (removed runs of bytes), rest."""
    ship(docs.sparkSession)
    text = bucketed(carry(docs), "texts", "doc_id")
    covered = repeated_strings(text, length).groupBy("doc_id").agg(F.collect_list(F.struct("pos", "m")).alias("spans"))
    rest = [c for c in text.columns if c not in ("doc_id", "text")]
    joined = text.join(covered, "doc_id", "left").select("doc_id", "text", place(), "spans", *rest)
    schema = "doc_id long, kept binary, n_bytes long, n_removed long, spans array<struct<start:int,end:int>>" + "".join(
        f", rest {text.schema['rest'].dataType.simpleString()}" for _ in rest
    )
    return joined.mapInArrow(lambda b: _remove(b, length), schema)


#: The removal over 400 bytes as DuckDB SQL, for tables whose doc_ids are unique and not null.
SQL = """
WITH d AS (SELECT doc_id, encode(coalesce(text, '')) AS b FROM documents),
starts AS (SELECT doc_id, b, unnest(range(1, octet_length(b) - 398)) AS pos FROM d),
strings AS (SELECT doc_id, pos, md5_number(b[pos:pos + 399]) AS k FROM starts),
again AS (SELECT doc_id, pos FROM strings QUALIFY count(*) OVER (PARTITION BY k) > 1),
marked AS (SELECT doc_id, pos, pos > lag(pos, 1, -400) OVER (PARTITION BY doc_id ORDER BY pos) + 400 AS fresh FROM again),
runs AS (SELECT doc_id, pos, count(*) FILTER (fresh) OVER (PARTITION BY doc_id ORDER BY pos) AS run FROM marked),
spans AS (SELECT doc_id, min(pos) AS first, max(pos) + 399 AS last FROM runs GROUP BY doc_id, run),
edges AS (SELECT doc_id, lag(last, 1, 0) OVER (PARTITION BY doc_id ORDER BY first) + 1 AS a, first - 1 AS z, last - first + 1 AS size, 1 AS spans FROM spans
  UNION ALL SELECT doc_id, max(last) + 1, NULL, 0, 0 FROM spans GROUP BY doc_id
  UNION ALL SELECT doc_id, 1, NULL, 0, 0 FROM d WHERE doc_id NOT IN (SELECT doc_id FROM spans)),
pieces AS (SELECT doc_id, a, CASE WHEN coalesce(z, octet_length(b)) >= a THEN hex(b[a:coalesce(z, octet_length(b))]) ELSE '' END AS piece, size, spans, octet_length(b) AS n
  FROM edges JOIN d USING (doc_id))
SELECT doc_id, any_value(n)::BIGINT AS n_bytes, sum(size)::BIGINT AS n_removed, sum(spans)::BIGINT AS n_spans, sha256(unhex(string_agg(piece, '' ORDER BY a))) AS kept_sha256
FROM pieces GROUP BY doc_id
"""
