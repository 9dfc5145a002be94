"""Language identification of mixed-language text.

Each word is scored for each language by byte n-grams (1 to 3 inside the word, marked at both ends) and
by the whole word; the script of its letters narrows the languages first. Viterbi over the words, with a
penalty for each switch, labels spans; the language that covers most bytes of words is the document's.

The model counts n-grams in at most ``sample`` training documents per language and a bounded number of bytes (both in
expectation), chosen by a hash of the doc_id. Scripts that a language uses for less than ``SCRIPT_SHARE`` of its letters are
not its own; a word in a script that no language owns may be any.

Defined results: a null text, or one without a letter (Unicode L), is ``und`` with score 0 and no spans;
equal coverage goes to the language that sorts first; with nothing to learn from, every text is ``und``. Rows repeat as given;
a row with a null doc_id gets a prediction and is not learned from; other columns don't matter.
The score is the share of the words' bytes that the spans of the language cover.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Roller, ship, text_blocks, words_of

SCRIPT_SHARE = 0.02
SWITCH = 14.0
BITS = {1: 8, 2: 16, 3: 17, 0: 18}  # table sizes by n-gram length; 0: whole words
#: Words held at once for the Viterbi pass; bounds a worker's memory.
HOLD = 4_000_000

#: First code point of each range of Unicode letters, and its script (fixed values).
SCRIPTS = (
    (0x0000, "Latin"), (0x0370, "Greek"), (0x0400, "Cyrillic"), (0x0530, "Armenian"), (0x0590, "Hebrew"), (0x0600, "Arabic"),
    (0x0700, "other"), (0x0900, "Devanagari"), (0x0980, "Bengali"), (0x0A00, "other"), (0x0B80, "Tamil"), (0x0C00, "Telugu"),
    (0x0C80, "other"), (0x0E00, "Thai"), (0x0E80, "other"), (0x10A0, "Georgian"), (0x1100, "Hangul"), (0x1200, "other"),
    (0x1E00, "Latin"), (0x1F00, "Greek"), (0x2000, "Latin"), (0x2E80, "Han"), (0x3040, "Kana"), (0x3100, "Han"),
    (0xA000, "other"), (0xAC00, "Hangul"), (0xD7B0, "other"), (0xF900, "Han"), (0xFB00, "other"), (0x20000, "Han"), (0x30000, "other"),
)
_NAMES = tuple(sorted({s for _, s in SCRIPTS}))
_FIRST = np.array([c for c, _ in SCRIPTS])
_SCRIPT = np.array([_NAMES.index(s) for _, s in SCRIPTS])


def has_letter(text: str | None) -> bool:
    """Whether a character is a letter (Unicode L: Lu, Ll, Lt, Lm, Lo); numbers such as U+00BD or U+2167 aren't."""
    return any(map(str.isalpha, text or ""))


@cache
def _is_letter() -> np.ndarray:
    """By code point."""
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def word_scripts(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Script of each word: that of its first letter beyond U+02FF, or else Latin. Marks and punctuation have no script."""
    out = np.full(len(starts), _NAMES.index("Latin"))
    lead = np.flatnonzero(buf >= 0xCD)  # U+0340 and later
    if not len(lead):
        return out
    b = np.concatenate([buf, np.zeros(4, np.uint8)]).astype(np.int64)
    c = b[lead]
    low = lambda k: b[lead + k] & 63
    cp = np.where(c < 0xE0, (c & 31) << 6 | low(1), np.where(c < 0xF0, (c & 15) << 12 | low(1) << 6 | low(2), (c & 7) << 18 | low(1) << 12 | low(2) << 6 | low(3)))
    letter = _is_letter()[cp]
    lead, cp = lead[letter], cp[letter]
    word = np.searchsorted(starts, lead, "right") - 1
    script = _SCRIPT[np.searchsorted(_FIRST, cp, "right") - 1]
    inside = (word >= 0) & (lead < ends[np.maximum(word, 0)])
    out[word[inside][::-1]] = script[inside][::-1]
    return out


def ngrams(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, roller: Roller) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each n-gram length: table slots, and offsets of each word's slots. Letters A-Z count as a-z."""
    size = ends - starts
    at = np.concatenate([[0], np.cumsum(size + 1)])  # words in a row, each after one space
    flat = np.full(int(at[-1]) + 1, 32, np.uint8)
    src = np.repeat(starts - at[:-1] - 1, size) + (np.arange(int(size.sum())) + np.repeat(np.arange(len(size)), size) + 1)
    letters = buf[src]
    letters = np.where((letters >= 65) & (letters <= 90), letters + 32, letters)
    flat[src - np.repeat(starts - at[:-1] - 1, size)] = letters
    v = flat.astype(np.uint32)
    yield 1, flat[:-1].astype(np.int32), at
    two = v[:-1] << np.uint32(8) | v[1:]
    yield 2, two.astype(np.int32), at  # the last starts with the last letter, and so includes the space after it
    three = (two[:-1] * np.uint32(0x9E3779B1)) ^ (v[2:] * np.uint32(0x85EBCA6B))
    three = ((three ^ (three >> np.uint32(15))) * np.uint32(0x2C1B3C6D)) >> np.uint32(32 - BITS[3])
    # a word's last letter has no trigram of its own: the one there reaches into the next word
    three = np.concatenate([three, three[-1:]])
    three[at[1:] - 1] = three[np.maximum(at[1:] - 2, 0)]
    yield 3, three.astype(np.int32), at
    word = roller.of(roller.prefix(roller.table[letters]), at[:-1] - np.arange(len(size)), at[1:] - np.arange(1, len(size) + 1))
    yield 0, (word >> np.uint64(64 - BITS[0])).astype(np.int32), np.arange(len(size) + 1)


@dataclass
class LanguageModel:
    langs: list[str]
    tables: dict[int, np.ndarray] = field(default_factory=dict)  # n-gram length: (slots, languages) log-probabilities
    scripts: np.ndarray | None = None  # (scripts, languages): may this script be that language

    def word_scores(self, buf, starts, ends, roller) -> np.ndarray:
        s = np.zeros((len(starts), len(self.langs)), np.float32)
        if not len(starts):
            return s
        for n, slots, at in ngrams(buf, starts, ends, roller):
            if n == 0:
                s += self.tables[0][slots]
            else:
                s += np.add.reduceat(self.tables[n][slots], at[:-1], axis=0)
        allowed = self.scripts[word_scripts(buf, starts, ends)]
        if not allowed.all():
            s = np.where(allowed, s, s.min() - 100)
        return s


def train(texts, langs: list[str]) -> LanguageModel:
    """Count n-grams of ``texts`` (a list or an Arrow column)."""
    import pyarrow as pa

    names = sorted(set(langs))
    code = np.array([names.index(x) for x in langs], np.int64)
    k = len(names)
    counts = {n: np.zeros((1 << b, k)) for n, b in BITS.items()}
    letters = np.zeros((len(_NAMES), k))
    roller = Roller(0)
    for lo, hi, buf, off in text_blocks(texts if isinstance(texts, pa.Array | pa.ChunkedArray) else pa.array(texts, pa.string())):
        starts, ends, first = words_of(buf, off)
        if not len(starts):
            continue
        lang = np.repeat(code[lo:hi], np.diff(first))
        np.add.at(letters, (word_scripts(buf, starts, ends), lang), 1)
        for n, slots, at in ngrams(buf, starts, ends, roller):
            own = np.repeat(lang, np.diff(at))
            counts[n] += np.bincount(slots[: len(own)].astype(np.int64) * k + own, minlength=counts[n].size).reshape(counts[n].shape)
    tables = {}
    for n, c in counts.items():
        soft = 0.2
        p = np.log((c + soft) / (c.sum(0) + soft * (1 << BITS[n])))
        tables[n] = (p - p.mean(1, keepdims=True)).astype(np.float32) * np.float32({1: 0.3, 2: 0.5, 3: 0.7, 0: 1.0}[n])
    owns = letters >= SCRIPT_SHARE * np.maximum(letters.sum(0), 1)
    owns[~owns.any(1)] = True
    return LanguageModel(names, tables, owns)


def viterbi(scores: np.ndarray, first: np.ndarray, penalty: float) -> np.ndarray:
    """Best label of each row of ``scores`` per document (rows first[i]:first[i + 1]), with a penalty for each change."""
    n, k = scores.shape
    label = np.zeros(n, np.int8 if k < 128 else np.int32)
    if k == 1 or not n:
        return label
    size = np.diff(first)
    order = np.argsort(-size, kind="stable")
    start, size = first[:-1][order], size[order]
    stay, origin = np.ones((n, k), bool), np.zeros(n, label.dtype)
    longest = int(size[0]) if len(size) else 0
    active = np.searchsorted(-size, -np.arange(1, longest + 1), "right")  # documents with at least t + 1 words
    v = np.zeros((len(size), k), np.float32)
    for t in range(longest):
        m = active[t]
        at = start[:m] + t
        x = v[:m]
        if t:
            best = x.argmax(1)
            bar = x[np.arange(m), best][:, None] - np.float32(penalty)
            stay[at] = x >= bar
            origin[at] = best
            np.maximum(x, bar, out=x)
            x -= x.max(1, keepdims=True)  # keeps long sums exact
        x += scores[at]
    now = v.argmax(1)
    for t in range(longest - 1, -1, -1):
        m = active[t]
        at = start[:m] + t
        cur = now[:m]
        label[at] = cur
        now[:m] = np.where(stay[at, cur], cur, origin[at])
    return label


def fit(docs: DataFrame, sample: int = 1500, sample_bytes: int = 64_000_000, languages: int = 200) -> LanguageModel:
    """Learn from rows with a language whose doc_id is not held out: at most ``sample`` of each language and ``sample_bytes``
    of text in all (both in expectation). More than ``languages`` languages are an error: the model has 1.8 MB for each."""
    known = docs.where("lang IS NOT NULL AND doc_id IS NOT NULL").where(~held_out()).select(F.col("doc_id").cast("long").alias("doc_id"), "lang", F.col("text").cast("string").alias("text"))
    sizes = known.groupBy("lang").agg(F.count("*").alias("rows"), F.sum(F.octet_length(F.coalesce("text", F.lit("")))).alias("bytes")).limit(languages + 1).collect()
    if not sizes:
        return LanguageModel([])
    if len(sizes) > languages:
        raise ValueError(f"over {languages} languages")
    each = sample_bytes / len(sizes)
    share = F
    for r in sorted(sizes, key=lambda r: r["lang"]):
        share = share.when(F.col("lang") == r["lang"], F.lit(int(1_000_000 * min(1.0, sample / r["rows"], each / max(1, r["bytes"])))))
    rows = known.where(F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(1_000_000)) < share).toArrow()
    rows = rows.sort_by([(c, "ascending") for c in ("doc_id", "lang", "text")])
    return train(rows["text"], rows["lang"].to_pylist())


def held_out(doc_id: str = "doc_id"):
    return F.crc32(F.col(doc_id).cast("string")) % 5 == 0


def _predict(batches: Iterator, model: LanguageModel, penalty: float) -> Iterator:
    import pyarrow as pa

    k = len(model.langs)
    roller = Roller(0)
    span_type = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("lang", pa.string())])
    names = np.array(model.langs)

    def flush(rows, held):
        scores, weight, first = (np.concatenate([h[i] for h in held]) for i in range(3)) if held else (np.zeros((0, max(k, 1))), np.zeros(0), np.zeros(0, np.int64))
        first = np.concatenate([[0], np.cumsum(first)])
        texts = rows.column(1)
        label = viterbi(scores, first, penalty) if k else np.zeros(len(weight), np.int8)
        doc = np.repeat(np.arange(len(texts)), np.diff(first))
        cover = np.bincount(doc * max(k, 1) + label, weight, minlength=len(texts) * max(k, 1)).reshape(len(texts), -1)
        total = cover.sum(1)
        best = cover.argmax(1)
        known = np.array([has_letter(t.as_py()) for t in texts], bool) & (total > 0) & (k > 0)
        lang = np.where(known, names[best] if k else "und", "und")
        share = np.where(known, cover[np.arange(len(texts)), best] / np.maximum(total, 1), 0.0)
        turn = np.ones(len(label), bool)
        turn[1:] = (label[1:] != label[:-1]) | (doc[1:] != doc[:-1])
        turn &= known[doc]
        run = np.flatnonzero(turn)
        stop = np.append(run[1:], 0)
        if len(run):
            last = np.append(doc[run[1:]] != doc[run[:-1]], True)
            stop = np.where(last, first[doc[run] + 1], stop)
            stop = np.minimum(stop, first[doc[run] + 1])
        stop = stop[: len(run)]
        base = first[doc[run]]
        offsets = np.concatenate([[0], np.cumsum(np.bincount(doc[run], minlength=len(texts)))]).astype(np.int32)
        spans = pa.ListArray.from_arrays(
            pa.array(offsets),
            pa.StructArray.from_arrays(
                [pa.array((run - base).astype(np.int32)), pa.array((stop - base).astype(np.int32)), pa.array(names[label[run]].tolist() if len(run) else [], pa.string())], fields=list(span_type)
            ),
        )
        return pa.RecordBatch.from_arrays([rows.column(0), pa.array(lang.tolist(), pa.string()), pa.array(share), spans], ["doc_id", "lang_pred", "score", "spans"])

    for b in batches:
        held, begin, words = [], 0, 0
        for lo, hi, buf, off in text_blocks(b.column(1)):
            starts, ends, first = words_of(buf, off)
            held.append((model.word_scores(buf, starts, ends, roller) if k else np.zeros((len(starts), 1)), (ends - starts).astype(np.float64), np.diff(first)))
            words += len(starts)
            if words > HOLD:
                yield flush(b.slice(begin, hi - begin), held)
                held, begin, words = [], hi, 0
        if begin < b.num_rows:
            yield flush(b.slice(begin), held)


def identify(docs: DataFrame, model: LanguageModel, penalty: float = SWITCH) -> DataFrame:
    """doc_id, lang_pred, score, spans (runs of words: start, end, lang) for each row of ``docs`` (doc_id, text)."""
    spark = docs.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(model)  # tables of fixed size for each of a bounded number of languages
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(
        lambda b: _predict(b, shared.value, penalty), "doc_id long, lang_pred string, score double, spans array<struct<start:int,end:int,lang:string>>"
    )
