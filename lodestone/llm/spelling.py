"""Spelling variant grouping by rolling-hash deletions.

Two words are near if one inserted, deleted or replaced letter makes one the other: then they agree once a letter is deleted
at one place from both (replaced), or once a letter is deleted from the longer one. So each word gives a key for itself and
two for each letter, made from polynomial hashes of what stands before and after it, in NumPy for a whole batch at once. Keys
are dealt by their leading bits (radix), sorted, and words with equal keys compared as strings.

No pairs are made. Words that differ in one given letter are as many as there are letters, and of a group each word only
needs its size and its most frequent other word. Each near pair meets in exactly one group.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import drop_staged, pick, staged

#: The letters of a word.
LETTER = "[A-Za-zÀ-ÿ]"
BASE = 0x9E3779B97F4A7C15
#: Texts of more characters are read run by run.
LONG = 1 << 22
REPLACED, SHORTER, WHOLE = 0, 1, 2
SENT = pa.schema([("bucket", pa.int32()), ("keys", pa.binary()), ("at", pa.binary()), ("place", pa.binary()), ("kind", pa.binary()), ("words", pa.list_(pa.string())), ("n", pa.list_(pa.int64()))])
SENT_SQL = "bucket int, keys binary, at binary, place binary, kind binary, words array<string>, n array<long>"
BEST_SQL = "word string, n_near long, form string, form_n long"


def damaged(doc_id: object, run: str, every: int) -> str:
    """run, or what is left of it once the letter that its checksum with the doc_id chooses is deleted (one in `every` runs)."""
    h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
    if h % every:
        return run
    i = h % len(run)
    return run[:i] + run[i + 1 :]


def _count(least: int, every: int | None, most: int = 400_000):
    found_in = re.compile(f"{LETTER}{{{least},}}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()
        for batch in batches:
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                # Lower-cased as bytes, only A-Z change.
                plain = text.as_buffer().to_pybytes().lower().decode()
                each = Counter(found_in.findall(plain) if len(plain) < LONG else (m[0] for m in found_in.finditer(plain)))
                for word, n in each.items():
                    if every is not None and len(word := damaged(i, word, every)) < least:
                        continue
                    held[word] += n
                if len(held) >= most:
                    yield _counted(held)
                    held = Counter()
        yield _counted(held)

    return run


def _counted(held: Counter) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], names=["word", "n"])


def count_words(docs: DataFrame, least: int = 7, times: int = 2, every: int | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """word, n: maximal runs of letters of whole texts, A-Z lower-cased, with `least` letters and `times` occurrences.

    With `every`, one run in so many loses a letter first, chosen by its checksum with the doc_id (a null one counts as empty).
    Null and empty texts have no words. Counts are summed in each task before they are exchanged, and a task holds a bounded
    number of words at once; of a very long text, it holds the distinct runs.
    """
    rows = pick(docs, doc_id=doc_id, text=text).filter(F.col("text").isNotNull()).select(F.col("doc_id").cast("string").alias("doc_id"), "text")
    return rows.mapInArrow(_count(least, every), "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= times)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def keys_of(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """key, index of the word, place of the deleted letter, kind: for each word one whole key, and for each letter one key
    of what is left with the place (REPLACED), and one without (SHORTER; only once where letters repeat)."""
    code = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
    size = np.array([len(w) for w in words], np.int64)
    end = np.cumsum(size)
    start, word = end - size, np.repeat(np.arange(len(words)), size)
    up, down = np.full(len(code) + 1, BASE, np.uint64), np.full(len(code) + 2, pow(BASE, -1, 1 << 64), np.uint64)
    up[0] = down[0] = 1
    up, down = np.cumprod(up), np.cumprod(down)
    total = np.zeros(len(code) + 1, np.uint64)
    np.cumsum(_mixed(code.astype(np.uint64) + np.uint64(BASE)) * up[:-1], out=total[1:])
    each = np.arange(len(code))
    first = start[word]
    before = (total[each] - total[first]) * down[first]
    after = (total[end[word]] - total[each + 1]) * down[first + 1]
    place = each - first
    gone = before + after
    fresh = np.ones(len(code), bool)
    fresh[1:] = (code[1:] != code[:-1]) | (place[1:] == 0)
    whole = (total[end] - total[start]) * down[start]
    key = np.concatenate([_mixed(gone ^ _mixed(place.astype(np.uint64) + np.uint64(1))), _mixed(gone[fresh]), _mixed(whole)])
    kind = np.repeat(np.array([REPLACED, SHORTER, WHOLE], np.uint8), [len(code), int(fresh.sum()), len(words)])
    return key, np.concatenate([word, word[fresh], np.arange(len(words))]), np.concatenate([place, place[fresh], np.zeros(len(words), np.int64)]), kind


def _send(buckets: int, most: int = 1 << 19):
    """Keys by bucket, each row with the words that it needs, for words of about `most` letters at once."""

    def rows(words: list[str], n: list[int]) -> Iterator[pa.RecordBatch]:
        key, word, place, kind = keys_of(words)
        bucket = ((key >> np.uint64(40)) * np.uint64(buckets) >> np.uint64(24)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        names, starts = np.unique(bucket[order], return_index=True)
        for b, i, j in zip(names.tolist(), starts, np.append(starts[1:], len(order))[: len(starts)], strict=True):
            part = order[i:j]
            used, at = np.unique(word[part], return_inverse=True)
            row = [b, key[part].tobytes(), at.astype(np.int32).tobytes(), place[part].astype(np.int32).tobytes(), kind[part].tobytes(), [words[w] for w in used], [n[w] for w in used]]
            yield pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(row, SENT, strict=True)], schema=SENT)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, n, held = [], [], 0
        for batch in batches:
            for word, count in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words.append(word)
                n.append(count)
                held += len(word)
                if held >= most:
                    yield from rows(words, n)
                    words, n, held = [], [], 0
        if words:
            yield from rows(words, n)

    return run


def _group(table: pa.Table) -> pa.Table:
    """For each word of a bucket how many near words it meets there, and the most frequent of them."""
    rows = table.to_pylist()
    words = [w for r in rows for w in r["words"]]
    n = np.array([x for r in rows for x in r["n"]], np.int64)
    shift = np.repeat(np.cumsum([0, *(len(r["words"]) for r in rows)])[:-1], [len(r["at"]) // 4 for r in rows])
    key, word, place, kind = (np.frombuffer(b"".join(r[c] for r in rows), t) for c, t in (("keys", np.uint64), ("at", np.int32), ("place", np.int32), ("kind", np.uint8)))
    word = word + shift
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    shared = np.concatenate([[False], same]) | np.concatenate([same, [False]])
    # A key that only shortened words have isn't of use, but needs no rule of its own: its groups have no whole word.
    order = order[shared]
    group = np.cumsum(np.concatenate([[True], key[order][1:] != key[order][:-1]])) - 1 if len(order) else np.zeros(0, np.int64)
    word, place, kind = word[order], place[order], kind[order]
    text = [words[w] if k == WHOLE else words[w][:p] + words[w][p + 1 :] for w, p, k in zip(word.tolist(), place.tolist(), kind.tolist(), strict=True)]
    told = [(g, t, p if k == REPLACED else -1) for g, t, p, k in zip(group.tolist(), text, place.tolist(), kind.tolist(), strict=True)]
    if any(a[0] == b[0] and a[1:] != b[1:] for a, b in zip(told, told[1:], strict=False)):  # a collision
        names = {x: i for i, x in enumerate(dict.fromkeys(told))}
        group = np.array([names[x] for x in told], np.int64)
    # Order of words, so that ties go to the smaller one.
    rank = np.empty(len(words), np.int64)
    rank[sorted(range(len(words)), key=words.__getitem__)] = np.arange(len(words))
    order = np.lexsort((rank[word], -n[word], kind == WHOLE, group))
    group, word, kind = group[order], word[order], kind[order]
    new = np.concatenate([[True], group[1:] != group[:-1]]) if len(group) else np.zeros(0, bool)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(group)) - 1 if len(group) else first
    size = last - first + 1
    of = np.cumsum(new) - 1
    replaced = kind == REPLACED
    centre = np.where(kind[last] == WHOLE, last, -1)  # the whole word sorts last
    near, best = np.zeros(len(group), np.int64), np.full(len(group), -1, np.int64)
    near[replaced] = size[of[replaced]] - 1
    second = np.minimum(first + 1, last)
    at = np.arange(len(group))
    best[replaced] = np.where(at[replaced] == first[of[replaced]], word[second[of[replaced]]], word[first[of[replaced]]])
    shorter = (kind == SHORTER) & (centre[of] >= 0)
    near[shorter], best[shorter] = 1, word[centre[of[shorter]]]
    whole = (kind == WHOLE) & (size[of] > 1)
    near[whole], best[whole] = size[of[whole]] - 1, word[first[of[whole]]]
    some = near > 0
    word, near, best = word[some], near[some], best[some]
    order = np.lexsort((rank[best], -n[best], word))  # a bucket has each word once
    word, near, best = word[order], near[order], best[order]
    first = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]])) if len(word) else np.zeros(0, np.int64)
    sums, top = np.add.reduceat(near, first) if len(first) else near, best[first]
    return pa.table({"word": pa.array([words[w] for w in word[first]], pa.string()), "n_near": pa.array(sums, pa.int64()), "form": pa.array([words[w] for w in top], pa.string()), "form_n": pa.array(n[top], pa.int64())})


def near_words(words: DataFrame, bucket_keys: int = 1 << 19) -> DataFrame:
    """word, n, n_near, form, form_n: how many words are near to each one, and the most frequent of them (ties: the smaller).

    `words` (word, n) holds each word once and should be a staged table; it is read three times. A word's keys are twice its letters;
    a bucket gets each batch's words once, so very long words aren't repeated for each key.
    """
    spark = words.sparkSession
    letters = words.agg(F.sum(F.length("word"))).first()[0] or 0
    buckets = max(2 * int(spark.conf.get("spark.sql.shuffle.partitions")), -(-2 * letters // bucket_keys))
    met = words.select("word", "n").mapInArrow(_send(buckets), SENT_SQL).groupBy("bucket").applyInArrow(_group, BEST_SQL)
    order = F.struct((-F.col("form_n")).alias("a"), F.col("form").alias("b"))
    best = met.groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min(order).alias("top")).select(F.col("word").alias("_word"), "n_near", F.col("top.b").alias("form"), (-F.col("top.a")).alias("form_n"))
    joined = words.join(best, F.col("word") == F.col("_word"), "left")
    return joined.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), "form", "form_n")


def group_variants(words: DataFrame, ratio: int = 10) -> DataFrame:
    """word, form, root, n, n_near, form_n for a staged table of words and counts.

    form: the most frequent near word, if it is `ratio` times as frequent; root: where following forms ends. Counts grow by
    the ratio with each step, so their logarithm bounds the steps, and pointers are followed twice as far each round. A word
    without near words has form null, n_near 0 and is its own root. Empty tables give no rows.
    """
    near = near_words(words)
    is_form = F.col("form_n") >= ratio * F.col("n")
    found = staged(near.select("word", F.when(is_form, F.col("form")).alias("form"), "n", "n_near", F.when(is_form, F.col("form_n")).alias("form_n")), "near")
    most, steps = found.agg(F.max("n")).first()[0] or 1, 1
    links = staged(found.filter(F.col("form").isNotNull()).select("word", F.col("form").alias("root")), "links")
    while ratio**steps <= most:
        onward = links.select(F.col("word").alias("root"), F.col("root").alias("next"))
        further = staged(links.join(onward, "root", "left").select("word", F.coalesce("next", "root").alias("root")), "links")
        drop_staged(links)
        links, steps = further, 2 * steps
    ends = links.select(F.col("word").alias("_word"), "root")
    return found.join(ends, F.col("word") == F.col("_word"), "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def variants(docs: DataFrame, least: int = 7, times: int = 2, every: int | None = None, ratio: int = 10, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """group_variants() of the words of whole texts; see count_words()."""
    return group_variants(staged(count_words(docs, least, times, every, doc_id, text), "words"), ratio)
