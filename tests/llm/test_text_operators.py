"""Chat formatting, substring and line dedup, decontamination and packing: brute force, round trips and odd inputs."""

from __future__ import annotations

import hashlib
import zlib
from collections import Counter, defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodestone.llm import chat_format, decontamination, line_dedup, packing, queries, substring_dedup

DOCS = "doc_id long, text string, Text string, ord int"


def docs(spark, rows):
    """Rows with extra columns whose names clash with the operators' own."""
    return spark.createDataFrame([(i, t, "other", 1) for i, t in rows], DOCS)


# --- op 1


@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "system", "tool [ROLE]"]), st.text(alphabet="ab\\ <>/s[]INSTROLEY\n", max_size=30)), max_size=6))
@settings(max_examples=200, deadline=None)
def test_template_is_read_back(turns):
    out, spans, rewritten = chat_format.locate(turns, chat_format.instruct)
    assert chat_format.parse_instruct(out) == turns and rewritten == -1
    assert [chat_format.unescape(out[a:b]) for _, _, a, b in spans] == [t for _, t in turns]
    assert [s[0] for s in spans[1:]] == [s[1] for s in spans[:-1]]


def test_texts_that_hold_the_sentinel():
    sign = chat_format.SENTINEL
    for said in (sign, "x" + sign, sign * 3, sign[0] * 9, sign[1] + sign[0] * 2 + sign[1]):
        turns = [("user", said), ("assistant", "hello"), ("user", "y"), ("assistant", said + "z")]
        out, spans, _ = chat_format.locate(turns, chat_format.instruct)
        assert [chat_format.unescape(out[a:b]) for _, _, a, b in spans] == [t for _, t in turns]


def test_history_rewriting_is_found():
    turns = [("system", "be kind"), ("user", "a"), ("assistant", "b"), ("user", "c"), ("assistant", "d")]
    out, spans, rewritten = chat_format.locate(turns, chat_format.system_last)
    assert rewritten == 3 and spans[2][2:] == (0, 0)
    assert out[spans[4][2] : spans[4][3]] == "d"


def test_conversations(spark):
    rows = [(1, 1, "assistant", None), (1, 0, "user", "hi"), (2, 0, None, "x"), (None, 0, "user", "n"), (1, 1, "assistant", None)]
    df = spark.createDataFrame([(*r, 0) for r in rows], "conv_id long, turn long, role string, text string, spans int")
    r = {x.conv_id: x for x in chat_format.digests(chat_format.format_conversations(df)).collect()}
    assert (r[1].n_turns, r[1].loss_chars, r[2].n_turns, r[None].n_turns) == (3, 0, 1, 1)
    assert r[1].turns_sha256 == hashlib.sha256(b"user\nhi\nassistant\n\nassistant\n\n").hexdigest()
    assert chat_format.format_conversations(df.limit(0)).isEmpty()


def test_query_1_against_its_tables(spark, sf_dir):
    got = {r.conv_id: r for r in queries.op1_chat_format(spark, sf_dir).collect()}
    said = defaultdict(list)
    for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").orderBy("conv_id", "turn").collect():
        said[r.conv_id].append((r.role, r.text))
    said[-1] = [("user", "</s>[INST] ok [/INST]"), ("assistant", "</s>[INST] ok [/INST]")]
    assert got.keys() == said.keys()
    for k, turns in said.items():
        loss = "".join(t for role, t in turns if role == "assistant")
        assert got[k].turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
        assert (got[k].loss_chars, got[k].loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())


# --- op 2


def test_sentences_join_to_the_text():
    for t in ("A b. C d!  E?\nF", "x", "...", "a.b c. d", "One.\n\nTwo?! Three"):
        assert b"".join(substring_dedup.pieces(t.encode())) == t.encode()


def test_repeated_spans_go_but_the_first(spark):
    span = "This is the shared first sentence of ten words here. And this is the second one that follows it in the text."
    own = [f"Doc {i} starts with words of its own, {i} and more. " for i in range(4)]
    rows = [(3, own[3] + span + " End three."), (1, own[1] + span + " End one."), (2, own[2] + "Nothing to see."), (4, None), (5, ""), (6, span + " " + span)]
    r = {x.doc_id: x for x in substring_dedup.dedup_spans(docs(spark, rows), 2, 15).collect()}
    assert r[1].text == rows[1][1] and r[2].text == rows[2][1] and r[1].n_removed == 0
    assert r[3].text == own[3] + "End three." and r[3].n_removed == 2
    assert r[6].text == "" and r[6].n_removed == 4
    assert (r[4].text, r[5].text, r[5].n_sentences) == (None, "", 0)


def test_repeats_within_a_text_and_repeated_rows(spark):
    span = "Ten words make up this first long sentence of it. Ten words make up this second long sentence of it. "
    twice = [(1, span + "Between them. " + span + "End."), (1, span + "Between them. " + span + "End.")]
    r = substring_dedup.dedup_spans(docs(spark, twice), 2, 15).collect()
    assert {x.text for x in r} == {span + "Between them. End."} and len(r) == 2
    assert substring_dedup.dedup_spans(docs(spark, []), 2, 15).isEmpty()


def test_passages_inside_long_sentences(spark):
    span = " ".join(f"p{i}" for i in range(60))
    whole = " ".join(f"w{i}" for i in range(200))
    rows = [(1, "own words stand before " + span + " and some other ones after it"), (2, "quite another start of this text " + span + " and its own end"), (3, whole), (4, whole), (5, "short text"), (6, "short text"), (7, " ".join(f"u{i}" for i in range(22))), (8, " ".join(f"u{i}" for i in range(22)))]
    r = {x.doc_id: x.text for x in substring_dedup.dedup_spans(docs(spark, rows)).collect()}
    assert all(r[i] == t for i, t in rows if i in (1, 3, 5, 6, 7))
    left = [w for w in r[2].split() if w.startswith("p")]
    assert len(left) < 35 and r[2].startswith("quite another start") and r[2].endswith("its own end") and r[4] == "" and r[8] == ""


# --- op 3


def brute_lines(rows):
    lines = [((i, n), frozenset(x for x in _words(line))) for i, t in rows if t is not None for n, line in enumerate(t.split("\n"))]
    first = {}
    for at, s in sorted(lines):
        if s:
            first.setdefault(s, at)
    near = {s: [x for x in first if x != s and 5 * len(x & s) >= 4 * len(x | s)] for s in first}
    goes = {s for s in first if any(first[x] < first[s] for x in near[s])}
    links = {s: sum((x in goes) != (s in goes) for x in near[s]) for s in first}
    return {at: (links.get(s, 0), not s or (first[s] == at and s not in goes)) for at, s in lines}


def _words(line):
    import re

    return [w for w in re.split("[\x00-\x20]+", line.lower()) if w]


def test_similar_lines_against_brute_force(spark):
    base = [f"w{i}" for i in range(40)]
    rows = [(1, " ".join(base[:10]) + "\n\nfew words"), (2, " ".join(base[:9]) + " zz\n" + " ".join(reversed(base[:10]))), (3, " ".join(base[1:10])), (4, " ".join(base)), (5, " ".join([*base[:36], "a", "b"])), (6, "\n".join(["few words", "Few  WORDS", "few"])), (7, ""), (8, None), (9, "x")]
    rows += [(10 + k, " ".join(base[: 20 + k])) for k in range(8)]
    got = {(r.doc_id, r.line_no): (r.n_links, r.kept) for r in line_dedup.dedup_lines(docs(spark, rows)).collect()}
    assert got == brute_lines(rows)


def test_large_groups_of_copies(spark):
    """Near copies whose first is and isn't near to all others, equal lines, and long lines; also whole steps are linear in a group."""
    base = [f"k{i}" for i in range(40)]
    near = [" ".join([*base[:k % 40], f"new{k}", *base[k % 40 + 1 :]]) for k in range(300)]
    apart = [" ".join([*(f"q{j}" for j in range(30)), *(f"r{(k + j) % 60}" for j in range(4))]) for k in range(120)]
    long = [f"l{i}" for i in range(200)]
    rows = [(i, t) for i, t in enumerate([" ".join(base), *near, *["one line of many"] * 300, *apart, *(" ".join([*long[:n], "x"]) for n in range(150, 200, 3))])]
    got = {(r.doc_id, r.line_no): (r.n_links, r.kept) for r in line_dedup.dedup_lines(docs(spark, rows)).collect()}
    assert got == brute_lines(rows)
    assert got[(0, 0)] == (300, True) and sum(got[(i, 0)][1] for i in range(301)) == 1


def test_long_similar_lines_with_few_signs_in_common(spark):
    """Sets around the sizes where signatures change, with as many words exchanged as 0.8 allows, and one more; rows repeat."""
    rows = []
    for n in (50, 63, 64, 70, 90, 127, 128, 150, 255, 256, 300):
        words = [f"t{n}_{i}" for i in range(n)]
        for k, changed in enumerate((0, n // 9, n // 9 + 1, n // 10)):
            rows.append((len(rows), " ".join([*(f"c{n}_{k}_{i}" for i in range(changed)), *words[changed:]])))
    got = line_dedup.dedup_lines(docs(spark, [*rows, *rows[:6], *rows[:6]])).collect()
    assert len(got) == len(rows) + 12
    assert {(r.doc_id, r.line_no): (r.n_links, r.kept) for r in got} == brute_lines(rows)
    assert sum(not x[1] for x in brute_lines(rows).values()) > 11


def test_rarities_are_no_column(spark, sf_dir, monkeypatch):
    """The table of rarities stays a constant of one expression: as a column, each line would hold it."""
    plans, write = {}, line_dedup.staged

    def seen(df, name):
        plans[name] = df._jdf.queryExecution().executedPlan().toString()
        return write(df, name)

    monkeypatch.setattr(line_dedup, "staged", seen)
    line_dedup.dedup_lines(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    assert "AS levels" not in plans["lines"] and "Subquery" in plans["lines"]
    assert not any(w in p for p in plans.values() for w in ("Python", "Arrow", "CartesianProduct", "BroadcastNestedLoopJoin"))


def test_rewritten_texts(spark):
    rows = [(1, "a b c d e\nf g"), (2, "A B C D E\nz"), (3, "a b c d e"), (4, None), (None, "f g")]
    got = {r.doc_id: r.text for r in line_dedup.without_repeats(docs(spark, rows)).toDF("doc_id", "text", "other", "ord").collect()}
    assert got == {1: "a b c d e\nf g", 2: "z", 3: "", 4: None, None: ""}
    assert line_dedup.dedup_lines(docs(spark, [])).isEmpty()


def test_similar_lines_at_one_place_keep_one(spark):
    near = ["a b c d e f g h i j", "a b c d e f g h i k", "a b c d e f g h i l"]
    for i in (None, 7):
        rows = [(i, t) for t in near]
        assert sum(r.kept for r in line_dedup.dedup_lines(docs(spark, rows)).collect()) == 1
        left = [r[1] for r in line_dedup.without_repeats(docs(spark, rows)).collect()]
        assert len(left) == 3 and sorted(left)[:2] == ["", ""] and max(left) in near


def test_similar_lines_of_very_many_words(spark):
    """Around and above the sizes that a posting has room for beside a signature, in both orders."""
    words = [f"v{i}" for i in range(140_000)]
    for a, b in ((140_000, 120_000), (120_000, 100_000), (70_000, 60_000), (36_000, 30_000)):
        for rows in ([(1, " ".join(words[:a])), (2, " ".join(words[:b]))], [(1, " ".join(words[:b])), (2, " ".join(words[:a]))]):
            got = {r.doc_id: (r.n_links, r.kept) for r in line_dedup.dedup_lines(docs(spark, [*rows, (3, " ".join(words[: b // 2]))])).collect()}
            assert got == {1: (1, True), 2: (1, False), 3: (0, True)}, (a, b)


def test_lines_of_very_many_words_just_at_the_threshold(spark):
    """One set has too many words for its position to be told, the other hasn't: at 0.8 no shared word may be lost."""
    words = [f"v{i}" for i in range(75_000)]
    for a, b in ((75_000, 60_000), (60_000, 75_000)):
        rows = [(1, " ".join(words[:a])), (2, " ".join(words[:b])), (3, " ".join([*words[:59_999], "x"]))]
        got = {r.doc_id: (r.n_links, r.kept) for r in line_dedup.dedup_lines(docs(spark, rows)).collect()}
        # 3 is like the set of 60,000, and just not like that of 75,000; it goes with either in front.
        assert got == ({1: (1, True), 2: (1, False), 3: (0, False)} if a > b else {1: (2, True), 2: (1, False), 3: (1, False)})


def test_join_of_postings_can_be_compiled(spark, sf_dir, monkeypatch, capsys):
    """The JVM never compiles a method of over 8,000 bytes; the join that tests all pairs must stay well below."""
    import re

    joined, told = line_dedup._joined, []

    def seen(classes, num, den):
        with monkeypatch.context() as m:
            m.setattr(line_dedup, "staged", lambda df, name: df)
            had = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")}
            try:
                for k, v in zip(had, ("false", "-1"), strict=True):
                    spark.conf.set(k, v)
                capsys.readouterr()
                joined(classes, num, den).explain("codegen")
            finally:
                for k, v in had.items():
                    spark.conf.set(k, v)
        told.extend(map(int, re.findall(r"maxMethodCodeSize:(\d+)", capsys.readouterr().out)))
        return joined(classes, num, den)

    monkeypatch.setattr(line_dedup, "_joined", seen)
    line_dedup.dedup_lines(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    assert told and max(told) < 6000


def test_many_rows_of_one_id_keep_one_copy_of_a_line(spark):
    """Far more texts than the bits of a hash by which places are ordered can tell apart without fail, all with one line in common."""
    from pyspark.sql import functions as F

    rows = spark.range(150_000).select(F.lit(None).cast("long").alias("doc_id"), F.concat(F.lit("one line for all\nown"), F.col("id").cast("string")).alias("text"))
    out = line_dedup.dedup_lines(rows).filter("line_no = 0")
    assert (out.count(), out.filter("kept").count()) == (150_000, 1)


def test_lines_are_coded_at_spaces_and_small_groups_left_to_the_join(spark, monkeypatch):
    """Words are split at one space, whatever separates them in the text; marks that few classes share aren't followed."""
    seps = [chr(i) for i in range(33) if chr(i) != "\n"]
    words = [f"s{i}" for i in range(20)]
    rows = [(0, " ".join(words)), *((i, f"{c}{c.join(words[:19])}{c}x{i}{c} {c}") for i, c in enumerate(seps, 1)), (40, "\t \r"), (41, "pair " + " ".join(f"p{i}" for i in range(12))), (42, " ".join(f"p{i}" for i in range(12)))]
    plans, leads, write = {}, [], line_dedup.staged

    def seen(df, name):
        plans.setdefault(name, df._jdf.queryExecution().executedPlan().toString())
        out = write(df, name)
        leads.extend([out.count()] * (name == "leads"))
        return out

    monkeypatch.setattr(line_dedup, "staged", seen)
    for some in (rows, rows[-3:]):
        leads.clear()
        got = {(r.doc_id, r.line_no): (r.n_links, r.kept) for r in line_dedup.dedup_lines(docs(spark, some)).collect()}
        assert got == brute_lines(some)
        assert bool(sum(leads)) == (some is rows)
    assert line_dedup.SPACE not in plans["lines"] and got[(42, 0)] == (1, False)


def test_pairs_of_near_copies_that_both_go_are_not_verified(spark, monkeypatch):
    """Where marks settle nothing, a group of m near copies still has few more verified pairs than copies, not all m * m / 2."""
    base, m = [f"k{i}" for i in range(40)], 60
    rows = [(0, " ".join(base)), *((k, " ".join([*base[: k % 40], f"new{k}", *base[k % 40 + 1 :]])) for k in range(1, m + 1))]
    verified, counts = line_dedup._verified, []

    def seen(pairs, *rest):
        counts.append(pairs.count())
        return verified(pairs, *rest)

    monkeypatch.setattr(line_dedup, "GROUP", 1 << 30)
    monkeypatch.setattr(line_dedup, "_verified", seen)
    got = {(r.doc_id, r.line_no): (r.n_links, r.kept) for r in line_dedup.dedup_lines(docs(spark, rows)).collect()}
    assert got == brute_lines(rows) and got[(0, 0)] == (m, True)
    assert sum(counts) <= 4 * m


# --- op 6


def test_pieces_are_cut_from_the_front():
    assert packing.cut(10, 16) == [(0, 10)] and packing.cut(16, 16) == [(0, 16)] and packing.cut(37, 16) == [(0, 5), (5, 16), (21, 16)]


@given(st.lists(st.integers(1, 64), max_size=200))
@settings(max_examples=150, deadline=None)
def test_packing_is_valid_and_tight(sizes):
    matches, used = packing.pack(dict(Counter(sizes)), 64)
    at = defaultdict(list)
    for size, a, b, first, each, base in matches:
        for r in range(a, b):
            at[first + (r - a) // each].append((base + (r - a) % each * size, size))
    assert Counter(s for v in at.values() for _, s in v) == Counter(sizes) and len(at) == used
    for v in at.values():
        end = 0
        for offset, size in sorted(v):
            assert offset == end
            end += size
        assert end <= 64
    gaps, bins = [], 0
    for s in sorted(sizes, reverse=True):  # item by item best fit
        fit = min((g for g in gaps if g >= s), default=None)
        if fit is None:
            bins, fit = bins + 1, 64
        else:
            gaps.remove(fit)
        gaps.append(fit - s)
    assert used == bins


def test_ids_are_the_tokenizers(spark):
    path = queries.tokenizer_path()
    encode = packing.Encoder(path)
    texts = ["", " ", "Hello  world\n\n it's 12 ok", "ñandú éà ß ½ ³", "a\x1cb\x85c\xa0d\x0b", "漢字 😀 <|endoftext|>", "x" * 3000, "they'LL don't\t\t "]
    assert all(encode(t) == encode.whole(t) for t in texts)


def test_packed_pieces(spark):
    path = queries.tokenizer_path()
    rows = [(1, "some words here " * 40), (2, None), (3, ""), (2, None), (None, "x y z"), (4, "other words there " * 9)]
    out = packing.best_fit(docs(spark, rows), path, capacity=32).collect()
    ids = packing.Encoder(path)
    whole = {i: ids(t or "") + bytes(4) for i, t in rows}
    seen = defaultdict(list)
    for r in out:
        raw = whole[r.doc_id][4 * r.start : 4 * (r.start + r.length)]
        assert zlib.crc32(raw) == r.ids_crc32 and len(raw) == 4 * r.length
        seen[r.sequence_id].append((r.offset, r.length))
    assert sum(r.length for r in out) == sum(len(whole[i]) // 4 for i, _ in rows)
    for v in seen.values():
        end = 0
        for offset, length in sorted(v):
            assert offset == end
            end += length
        assert end <= 32
    assert packing.best_fit(docs(spark, []), path).isEmpty()


# --- op 7


def brute_containment(rows, items, share=0.8):
    out = set()
    for d, t in rows:
        for i, x in items:
            w, v = decontamination.spell(x), decontamination.spell(t)
            n = min(5, len(w))
            a, b = decontamination.spelled_shingles(w, n) if w else set(), decontamination.spelled_shingles(v, n) if w else set()
            if a and len(a & b) >= share * len(a):
                out.add((d, i, len(a), len(a & b)))
    return out


def test_items_inside_long_texts(spark):
    item = " ".join(f"k{i}" for i in range(30))
    near = item.replace("k15", "other").replace("k3 ", "K3 ")
    rows = [(1, "x y " * 500 + item.upper() + " tail" * 400), (2, "a " + near), (3, " ".join(f"k{i}" for i in range(20))), (4, None), (5, ""), (6, "short item"), (7, "a Short-Item here"), (1, item)]
    items = [(1, item), (2, "short item"), (3, ""), (4, None), (5, "word"), (6, "k0 k1 k2 k3 k4 k5")]
    table = spark.createDataFrame([(i, t, 0) for i, t in items], "item_id long, text string, doc_id int")
    got = [(r.doc_id, r.item_id, r.n_shingles, r.n_found) for r in decontamination.find_items(docs(spark, rows), table).collect()]
    assert set(got) == brute_containment(rows, items) and (1, 1, 26, 26) in got and (6, 2, 1, 1) in got
    blocks = decontamination.find_items(docs(spark, rows), table, block_bytes=100).collect()
    assert sorted((r.doc_id, r.item_id, r.n_shingles, r.n_found) for r in blocks) == sorted(got)
    assert decontamination.find_items(docs(spark, []), table).isEmpty() and decontamination.find_items(docs(spark, rows), table.limit(0)).isEmpty()
