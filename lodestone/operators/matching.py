"""Texts against tables of words and patterns, of any size, without a nested loop (JN10, JN16, FIL22).

Words are one Aho-Corasick automaton, which reads each text once, however many words there are. A regular expression waits
behind the literals of which it needs one: only texts that hold one of these are matched with it. Containment the other way round (a
phrase within a word of the table) is a join on the phrase's rarest n-gram.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from re import _constants as C
from re import _parser

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Letters that a pattern matches without regard to case, but that lower() leaves apart.
ALIKE = str.maketrans({"ſ": "s", "ı": "i", "µ": "μ", "ς": "σ"})


def plain(text: str) -> str:
    """text as literals are looked for in it: without case."""
    return text.lower().translate(ALIKE)


def required(pattern: str) -> set[str] | None:
    """Literals (in plain()) of which any match of the pattern holds at least one; None if there are no such literals.

    Raises re.error for what is no pattern.
    """
    return _required(list(_parser.parse(pattern)))


def _required(items: list) -> set[str] | None:
    found, run = [], ""
    for op, arg in [*items, (None, None)]:
        if op is C.LITERAL:
            run += chr(arg)
            continue
        if run:
            found.append({plain(run)})
            run = ""
        inner = None
        if op is C.SUBPATTERN:
            inner = _required(list(arg[3]))
        elif op in (C.MAX_REPEAT, C.MIN_REPEAT, C.POSSESSIVE_REPEAT) and arg[0] > 0:
            inner = _required(list(arg[2]))
        elif op is C.ATOMIC_GROUP:
            inner = _required(list(arg))
        elif op is C.BRANCH:
            each = [_required(list(b)) for b in arg[1]]
            inner = set().union(*each) if all(each) else None
        if inner:
            found.append(inner)
    return max(found, key=lambda s: (min(map(len, s)), -len(s)), default=None)


def _fired(rules: list[tuple[int, str]], keys: list[str]):
    """keys, ord for each rule that a text fires."""
    held: list = []

    def build() -> tuple:
        automaton, always, tests = ahocorasick.Automaton(), [], {}
        by_literal: dict[str, list[int]] = {}
        for i, (_, pattern) in enumerate(rules):
            literals = required(pattern)
            if re.escape(pattern) != pattern or plain(pattern) != pattern:
                tests[i] = re.compile(pattern)
            if literals is None:
                always.append(i)
            for x in literals or ():
                by_literal.setdefault(x, []).append(i)
        for x, which in by_literal.items():
            automaton.add_word(x, which)
        automaton.make_automaton()
        return automaton, always, tests, bool(by_literal)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not held:
            held.append(build())
        automaton, always, tests, some = held[0]
        for batch in batches:
            at, ords = [], []
            for row, text in enumerate(batch.column(len(keys)).to_pylist()):
                near = set(always)
                if some:
                    for _, which in automaton.iter(plain(text)):
                        near.update(which)
                for i in near:
                    # Literals are found without case; a rule with case, or one that is more than a literal, is matched itself.
                    if (rule := tests.get(i)) is None and rules[i][1] not in text or rule is not None and not rule.search(text):
                        continue
                    at.append(row)
                    ords.append(rules[i][0])
            taken = batch.select(list(range(len(keys)))).take(pa.array(at, pa.int64()))
            yield pa.RecordBatch.from_arrays([*taken.columns, pa.array(ords, pa.int64())], names=[*keys, "ord"])

    return run


def fired(texts: DataFrame, rules: DataFrame, keys: list[str], text: str, block_mb: int = 64) -> DataFrame:
    """keys, ord: which rules (ord, pattern: Python's syntax) match which texts, each pair once.

    The rule table is sent to workers in blocks of at most `block_mb`; a larger one takes as many scans of the texts. Null texts
    fire nothing; a rule without a pattern never fires.
    """
    sound = rules.filter(F.col("pattern").isNotNull()).select(F.col("ord").cast("long").alias("ord"), "pattern")
    size = sound.agg(F.sum(F.octet_length("pattern") + 16)).first()[0] or 0
    blocks = max(1, -(-size // (block_mb << 20)))
    plain_texts = texts.filter(F.col(text).isNotNull()).select(*keys, text)
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in plain_texts.schema.fields[: len(keys)])
    out = None
    for i in range(blocks):
        block = [(r.ord, r.pattern) for r in sound.filter(F.pmod(F.xxhash64("ord", "pattern"), F.lit(blocks)) == i).collect()]
        part = plain_texts.mapInArrow(_fired(block, keys), f"{kinds}, ord long")
        out = part if out is None else out.unionAll(part)
    return out


def _grams(text: str, size: int) -> list:
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(text) - size + 1, F.lit(1))), lambda i: F.substring(F.col(text), i, F.lit(size))))


def within(phrases: DataFrame, words: DataFrame, phrase: str = "phrase", word: str = "word", size: int = 3) -> DataFrame:
    """phrase, word: which of the distinct phrases lie within which words.

    A phrase of `size` letters or more is looked up by the one of its n-grams that the fewest words have, a shorter one by
    itself. A phrase with an n-gram that no word has lies in none. Empty phrases lie in none here.
    """
    p = phrases.select(F.col(phrase).alias("_p")).filter(F.length("_p") > 0).distinct()
    w = words.select(F.col(word).alias("_w")).filter(F.length("_w") > 0).distinct()
    listed = w.select("_w", F.explode(F.array_distinct(F.flatten(F.array(*[_grams("_w", n) for n in range(1, size + 1)])))).alias("_g"))
    counts = listed.groupBy("_g").agg(F.count(F.lit(1)).alias("_n"))
    asked = p.select("_p", F.explode(_grams("_p", size)).alias("_g")).join(counts, "_g", "left")
    best = asked.groupBy("_p").agg(F.min_by("_g", F.coalesce("_n", F.lit(0))).alias("_g"), F.min(F.coalesce("_n", F.lit(0))).alias("_n")).filter("_n > 0")
    found = best.select("_p", "_g").join(listed, "_g").filter(F.contains("_w", "_p"))
    return found.select(F.col("_p").alias(phrase), F.col("_w").alias(word))


def either_way(phrases: DataFrame, words: DataFrame, phrase: str = "phrase", word: str = "word", least: int = 3, both: int = 4) -> DataFrame:
    """The distinct phrases that are on a list of words: equal to one, or one within the other (JN16).

    Within: the word has at least `least` letters, and not both have under `both`. Empty and null phrases are on no list.
    """
    p = phrases.select(F.col(phrase).alias("phrase")).filter(F.length("phrase") > 0).distinct()
    w = words.select(F.col(word).alias("word")).filter(F.length("word") > 0).distinct()
    same = p.join(w, p["phrase"] == w["word"], "left_semi")
    long_ = F.length("word") >= least
    enough = (F.length("word") >= both) | (F.length("phrase") >= both)
    inside = within(p, w.filter(long_)).filter(enough).select("phrase")
    rules = w.filter(long_).select(F.xxhash64("word").alias("ord"), F.regexp_replace("word", r"([^\p{L}\p{N}_\s])", r"\\$1").alias("pattern"), F.length("word").alias("_n"))
    holds = fired(p, rules, ["phrase"], "phrase").join(rules.select("ord", "_n").dropDuplicates(["ord"]), "ord").filter((F.col("_n") >= both) | (F.length("phrase") >= both)).select("phrase")
    return same.unionAll(inside).unionAll(holds).distinct()
