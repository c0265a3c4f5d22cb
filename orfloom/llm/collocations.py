"""Phrase collocations by pivot partitioning.

An n-gram belongs to its *pivot*: its rarest word, and of equal words the first.
Every word of a text routes one *fragment* to its own partition: itself with the
words around it that can stand in n-grams it owns (up to two on each side,
ending at a rarer word, at a word too rare for any phrase, and at the piece's
end; on the left also at the word itself).  So each occurrence of an n-gram lies
in exactly one fragment with its pivot in it: partitions count the n-grams of
their pivots alone, and only frequent ones leave them.

* Words are counted exactly (by language) before they are ranked.  A rank is the
  count in a fixed-size summary of 2**SLOT_BITS hash slots, ties by hash: any
  fixed order gives the same phrases, the rarest-first one gives short fragments.
  A slot's count is never below a word's, so no frequent word is taken for rare.
* Equal fragments are counted before they travel.  A pivot that holds a share of
  1 / HOT_SHARE of a language's words is dealt to SALTS partitions by fragment.
* A task mines blocks of a few MB of fragments, which end between two pivots.
  Of a pivot with all its fragments in one block only the frequent n-grams leave;
  n-grams of dealt pivots, and of pivots that fill more than a block, leave with
  their counts so far.  These few rows are added up at the end.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from orfloom.llm import scratch
from orfloom.llm.textops import Words, chunks, lean, mix, split_words

#: Slots of the word-count summary (4 bytes each), whatever the corpus.
SLOT_BITS, BLOCK_BITS = 22, 14
#: A pivot with one of so many words of its language is dealt to SALTS partitions.
HOT_SHARE, SALTS = 256, 64
#: Keys with a share of 1 / HOT_KEYS of the rows are joined by broadcast.
HOT_KEYS = 1024
#: Groups that the ranks of a language are cut to before the last one.
TOP_GROUPS = 256
#: Bytes of text, and of fragments, that are worked on at once.
CHUNK, BLOCK_BYTES = 3 << 20, 4 << 20

#: floor(10**6 a*a / (l*r)) in decimals of 38 digits.
SCORE = "(cast(a as decimal(16,0)) * cast(a as decimal(16,0)) * cast(1000000 as decimal(7,0))) div (cast(l as decimal(19,0)) * cast(r as decimal(19,0)))"

_PIECE = np.zeros(256, bool)
_PIECE[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
_BREAK = _PIECE.copy()
_BREAK[[0x20, 0x09]] = True
_LANG = np.uint64(0xD6E8FEB86659FD93)


def _slots(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(64 - SLOT_BITS)).astype(np.int64)


def _by_lang(batch: pa.RecordBatch):
    """(lang, texts) of a batch, chunk by chunk."""
    langs = np.array(batch.column("lang").to_pylist(), object)
    texts = batch.column("text").cast(pa.binary()).to_pylist()
    for lang in sorted(set(langs)):
        for _, part in chunks((texts[i] for i in np.flatnonzero(langs == lang)), CHUNK):
            yield lang, part


def _seeded(w: Words, lang: str) -> np.ndarray:
    """Hashes of the words as words of a language."""
    return mix(w.hash ^ np.uint64(xxhash.xxh64_intdigest(lang.encode())))


def _strings(w: Words, first: np.ndarray, last: np.ndarray) -> list[bytes]:
    """Words first to last, joined by one space each."""
    a, b = w.start[first], w.end[last]
    raw = w.buf.tobytes()
    out = [raw[x:y] for x, y in zip(a.tolist(), b.tolist())]
    odd = np.cumsum(np.append(False, (w.start[1:] != w.end[:-1] + 1) | (w.buf[w.end[:-1]] != 0x20)))
    for i in np.flatnonzero(odd[last] != odd[first]):
        out[i] = b" ".join(out[i].replace(b"\t", b" ").split())
    return out


def _rows(lang: str, **columns) -> pa.RecordBatch:
    n = len(next(iter(columns.values())))
    return pa.RecordBatch.from_arrays([pa.array([lang] * n, pa.string()), *[c if isinstance(c, pa.Array) else pa.array(c) for c in columns.values()]], ["lang", *columns])


def _count_words(batches):
    for batch in batches:
        for lang, part in _by_lang(batch):
            w = split_words(part, lower=True, space=_BREAK)
            if len(w.hash):
                _, first, n = np.unique(w.hash, return_index=True, return_counts=True)
                yield _rows(lang, word=pa.array(_strings(w, first, first), pa.binary()).cast(pa.string()), n=n)


def _slot_counts(batches):
    for batch in batches:
        langs = np.array(batch.column("lang").to_pylist(), object)
        words, n = batch.column("word").cast(pa.binary()), batch.column("n").to_numpy()
        for lang in sorted(set(langs)):
            at = np.flatnonzero(langs == lang)
            w = split_words(words.take(pa.array(at)).to_pylist(), space=_BREAK)
            slot, back = np.unique(_slots(_seeded(w, lang)), return_inverse=True)
            yield pa.RecordBatch.from_arrays([pa.array(slot), pa.array(np.bincount(back, weights=n[at]).astype(np.int64))], ["slot", "n"])


def _pack_block(key, table):
    """The counts of 2**BLOCK_BITS slots, at most 2**32 - 1 each."""
    total = np.zeros(1 << BLOCK_BITS, "<u4")
    total[table.column("slot").to_numpy() & ((1 << BLOCK_BITS) - 1)] = np.minimum(table.column("n").to_numpy(), (1 << 32) - 1)
    return pa.table({"block": pa.array([key[0].as_py()], pa.int64()), "counts": pa.array([total.tobytes()], pa.binary())})


def word_summary(words: DataFrame) -> np.ndarray:
    """Counts of the hash slots of words(lang, word, n), at most 2**32 - 1 each."""
    found = words.mapInArrow(lean(_slot_counts), "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n"))
    parts = found.withColumn("block", F.shiftright("slot", BLOCK_BITS)).groupBy("block").applyInArrow(_pack_block, "block long, counts binary")
    out = np.zeros(1 << SLOT_BITS, np.uint32)
    for r in parts.collect():
        out[r["block"] << BLOCK_BITS : (r["block"] + 1) << BLOCK_BITS] = np.frombuffer(r["counts"], "<u4")
    return out


def _reach(piece: np.ndarray, rank_ok: list[np.ndarray]) -> np.ndarray:
    """Words on one side that belong to the fragment: rank_ok[k] says whether word k + 1 may, if those nearer do."""
    out, alive = np.zeros(len(piece), np.int64), np.ones(len(piece), bool)
    for ok in rank_ok:
        alive = alive & ok
        out += alive
    return out


def _fragments(summary, hot, least: int, longest: int):
    def rows(batches):
        for batch in batches:
            for lang, part in _by_lang(batch):
                w = split_words(part, lower=True, space=_BREAK)
                n = len(w.hash)
                if n < 2:
                    continue
                breaks = np.cumsum(_PIECE[w.buf])
                piece = breaks[w.start]
                piece = piece + np.repeat(np.arange(len(part)) * (breaks[-1] + 1), np.diff(w.bound))
                h = _seeded(w, lang)
                count = summary.value[_slots(h)]
                common = count >= least
                left, right = [], []
                for k in range(1, longest):
                    far = np.full(n, False)
                    # Word i + k stands right of word i, and word i left of word i + k.
                    a, b = slice(0, max(0, n - k)), slice(min(k, n), n)
                    same = (piece[a] == piece[b]) & common[a] & common[b]
                    ahead, behind = far.copy(), far.copy()
                    rarer = (count[a] < count[b]) | ((count[a] == count[b]) & (h[a] <= h[b]))  # or equal: word i owns what both are in
                    ahead[a], behind[b] = same & rarer, same & ~rarer
                    left.append(behind)
                    right.append(ahead)
                before, after = _reach(piece, left), _reach(piece, right)
                at = np.flatnonzero(before + after)
                if not len(at):
                    continue
                first, last = at - before[at], at + after[at]
                name = np.full(len(at), np.uint64(0))
                for k in range(2 * longest - 1):
                    word = first + k
                    inside = word <= last
                    name[inside] = mix(name[inside] * _LANG + h[word[inside]])
                name = mix(name ^ (before[at] * (longest + 1) + after[at]).astype(np.uint64))
                _, one, times = np.unique(name, return_index=True, return_counts=True)
                pivot = h[at[one]]
                salt = np.where(np.isin(pivot, hot.value), name[one] % np.uint64(SALTS), np.uint64(0))
                yield _rows(
                    lang, pivot=pivot.view(np.int64), hot=pa.array(np.isin(pivot, hot.value)), salt=salt.astype(np.int32), place=before[at[one]].astype(np.int32),
                    fragment=pa.array(_strings(w, first[one], last[one]), pa.binary()).cast(pa.string()), n=times,
                )

    return rows


def _hot_pivots(words: DataFrame, totals: DataFrame) -> np.ndarray:
    """Hashes of the words that hold a share of 1 / HOT_SHARE of their language: at most HOT_SHARE a language."""
    rows = words.join(F.broadcast(totals), "lang").where(F.col("n") * HOT_SHARE >= F.col("total")).select("lang", "word").collect()
    found = [_seeded(split_words([r.word.encode()], space=_BREAK), r.lang) for r in rows]
    return np.unique(np.concatenate(found)) if found else np.zeros(0, np.uint64)


def _mine_block(langs: list, pivot: np.ndarray, hot: np.ndarray, place: np.ndarray, fragments: list[bytes], n: np.ndarray, least: int, longest: int, partial: set):
    """(lang, phrase, n) of the n-grams with their pivot in them, of fragments of some pivots; partial pivots give all, others those that occur ``least`` times."""
    w = split_words(fragments, space=_BREAK)
    kinds = sorted(set(langs))
    lang = np.searchsorted(kinds, langs)
    open_ended = hot | np.isin(pivot, list(partial))
    names, firsts, sizes, owners = [], [], [], []
    for size in range(2, longest + 1):
        for back in range(size):
            start = w.bound[:-1] + place - back
            ok = np.flatnonzero((place >= back) & (start + size <= w.bound[1:]))
            name = (lang[ok] * (longest + 1) + size).astype(np.uint64)
            for k in range(size):
                name = mix(name * _LANG + w.hash[start[ok] + k])
            names.append(name)
            firsts.append(start[ok])
            sizes.append(np.full(len(ok), size))
            owners.append(ok)
    names, firsts, sizes, owners = (np.concatenate(x) for x in (names, firsts, sizes, owners))
    _, one, back = np.unique(names, return_index=True, return_inverse=True)
    total = np.bincount(back, weights=n[owners], minlength=len(one)).astype(np.int64)
    keep = np.flatnonzero((total >= least) | open_ended[owners[one]])
    one = one[keep]
    for k in np.unique(lang[owners[one]]):
        own = np.flatnonzero(lang[owners[one]] == k)
        phrases = _strings(w, firsts[one[own]], firsts[one[own]] + sizes[one[own]] - 1)
        yield _rows(kinds[k], phrase=pa.array(phrases, pa.binary()).cast(pa.string()), n=total[keep[own]])


def _mine(least: int, longest: int, most: int):
    def rows(batches):
        """Rows come by pivot and salt; a block ends between two pivots, or, if it gets too large, within one, which is partial then."""
        held, size, cut = [], 0, None

        def block(end):
            pivots = np.concatenate([h[1] for h in held])
            partial = ({cut} if cut is not None else set()) | ({int(pivots[-1])} if end is not None and pivots[-1] == end else set())
            langs, fragments = [x for h in held for x in h[0]], [x for h in held for x in h[4]]
            return _mine_block(langs, pivots, *(np.concatenate([h[k] for h in held]) for k in (2, 3)), fragments, np.concatenate([h[5] for h in held]), least, longest, partial)

        for batch in batches:
            column = lambda c: batch.column(c).to_numpy(zero_copy_only=False)  # noqa: B023, E731
            pivot, fragments = column("pivot"), batch.column("fragment").cast(pa.binary()).to_pylist()
            langs = batch.column("lang").to_pylist()
            edges = [0, *(np.flatnonzero(np.diff(pivot)) + 1).tolist(), len(pivot)]
            parts = [column(c) for c in ("hot", "place", "n")]
            done = 0
            for e in edges[1:]:
                size += sum(map(len, fragments[done:e])) + 8 * (e - done)
                held.append((langs[done:e], pivot[done:e], parts[0][done:e], parts[1][done:e].astype(np.int64), fragments[done:e], parts[2][done:e]))
                done = e
                if size > most:
                    end = int(pivot[e - 1])
                    goes_on = e == len(pivot) or int(pivot[e]) == end
                    yield from block(end if goes_on else None)
                    held, size, cut = [], 0, end if goes_on else None
        if held:
            yield from block(None)

    return rows


def _with(rows: DataFrame, keys: list[str], values: DataFrame) -> DataFrame:
    """rows joined to values(keys, ...) on keys; keys that stand in a large share of the rows go by broadcast."""
    many = rows.groupBy(*keys).count()
    total = rows.count()
    hot = scratch.table(many.where(F.col("count") * HOT_KEYS >= total).where("count > 1").select(*keys), "hot-keys")
    hot = F.broadcast(hot)
    often = values.join(hot, keys, "left_semi")
    return rows.join(F.broadcast(often), keys).unionByName(rows.join(hot, keys, "left_anti").join(values, keys))


def phrase_counts(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = 10, longest: int = 3) -> tuple[DataFrame, DataFrame]:
    """words(lang, word, n), all of them, and phrases(lang, phrase, n) of 2 to ``longest`` words that occur ``least`` times."""
    spark = docs.sparkSession
    scratch.small_batches(spark)
    src = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    words = scratch.table(src.mapInArrow(lean(_count_words), "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n")), "words")
    totals = words.groupBy("lang").agg(F.sum("n").alias("total"))
    summary, hot = spark.sparkContext.broadcast(word_summary(words)), spark.sparkContext.broadcast(_hot_pivots(words, totals))
    schema = "lang string, pivot long, hot boolean, salt int, place int, fragment string, n long"
    dealt = src.mapInArrow(lean(_fragments(summary, hot, least, longest)), schema).repartition("pivot", "salt").sortWithinPartitions("pivot", "salt")
    mined = dealt.drop("salt").mapInArrow(lean(_mine(least, longest, BLOCK_BYTES)), "lang string, phrase string, n long")
    phrases = mined.groupBy("lang", "phrase").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
    return words, scratch.table(phrases, "phrases")


def collocations(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = 10, longest: int = 3, covered: int = 50, top: int = 2000) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's ``top`` phrases of 2 to ``longest`` words.

    a counts the phrase's occurrences within pieces, overlaps included; n the
    language's words.  The phrase is cut where floor(10**6 a*a / (l*r)) is least
    (the smallest place, if several), l and r being the counts of both parts.
    A phrase of less than ``least`` occurrences is none, and one that stands in
    a longer phrase with ``covered`` per cent of its occurrences is dropped.
    Order: score, a (both descending), phrase.

    A-Z are lower-cased.  A null text has no words; a null language is ``und``;
    repeated rows count each; a text without separators is one word; an empty
    table gives an empty result; other columns are not read.  Products are
    decimals of 38 digits.
    """
    words, phrases = phrase_counts(docs, text_col, lang_col, least, longest)
    totals = words.groupBy("lang").agg(F.sum("n").alias("n"))
    parts = scratch.table(words.where(F.col("n") >= least).withColumnRenamed("word", "phrase").union(phrases), "parts")
    own = F.split("phrase", " ", -1)
    each = phrases.select("lang", "phrase", F.col("n").alias("a"), own.alias("own"), F.explode(F.sequence(F.lit(1), F.size(own) - 1)).alias("k"))
    join = lambda first, n: F.array_join(F.slice("own", first, n), " ")
    each = each.select("lang", "phrase", "a", "k", join(F.lit(1), F.col("k")).alias("head"), join(F.col("k") + 1, F.size("own") - F.col("k")).alias("tail"))
    each = scratch.table(each, "cuts")
    each = scratch.table(_with(each, ["lang", "head"], parts.selectExpr("lang", "phrase AS head", "n AS l")), "heads")
    each = _with(each, ["lang", "tail"], parts.selectExpr("lang", "phrase AS tail", "n AS r"))
    wide = lambda c: F.col(c).cast("decimal(19,0)")
    best = each.withColumn("score", F.expr(SCORE)).groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"), F.first("a").alias("a"))
    inner = lambda n: [(i, n) for i in range(1, longest - n + 2)]
    inside = [F.when((F.size("own") > n) & (F.size("own") >= i + n - 1), join(F.lit(i), F.lit(n))) for n in range(2, longest) for i, n in inner(n)]
    if inside:
        longer = phrases.withColumn("own", own).where("size(own) > 2").select("lang", F.col("n").alias("outer"), F.explode(F.array_compact(F.array(*inside))).alias("phrase"))
        longer = longer.groupBy("lang", "phrase").agg(F.max("outer").alias("outer"))
        best = best.join(longer, ["lang", "phrase"], "left").where(F.col("outer").isNull() | (wide("outer") * 100 < wide("a") * covered))
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    rows = best.select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score").withColumn("group", F.pmod(F.hash("phrase"), F.lit(TOP_GROUPS)))
    rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "group").orderBy(*order))).where(F.col("rank") <= top)
    rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    return rows.join(F.broadcast(totals), "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
