"""Documents to chunk rows by profiles: window chunks, breadcrumbs, sections, sparse terms and links (TF1, TF2, TF3, FIL20, WN5, WN9)."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions.text import FOLD, STOPWORDS

# What starts a block, a section named in a breadcrumb, and a policy text.
BLOCK = re.compile(r"^(#{1,6}\s+.+|(PHẦN|CHƯƠNG|MỤC)\s+[IVXLC\d]+.*|(Điều|Khoản)\s+\d+[\.:]?.*|[a-zđ]\)\s+.+)", re.IGNORECASE)
SECTION = re.compile(r"^(Chương|Điều|Khoản|Mục)\s+(\d+|[IVX]+)", re.MULTILINE)
POLICY = r"(?m)^(PHẦN|CHƯƠNG|MỤC|Điều|Khoản)\s+"
# Ranks of legal headings, the highest first.
LEVELS = ("phần", "chương", "mục", "điều", "khoản")
WORD = re.compile(r"\w+")
#: Rows that are read as Python objects at once, and characters of chunks that a task holds before it gives them on.
ROWS, HELD = 16, 1 << 20


@dataclass(frozen=True)
class Tokens:
    """How texts are counted and cut: words by default; encode and decode are inverse up to white space."""

    encode: Callable[[str], list] = str.split
    decode: Callable[[list], str] = " ".join


@dataclass(frozen=True)
class Profile:
    """How one kind of document is cut; sizes are in tokens. `prefer`: which of the texts comes first."""

    size: int
    overlap: int
    least: int
    separators: tuple[str, ...]
    prefer: tuple[str, ...] = ("text_plain", "text", "summary")
    tokens: Tokens = field(default_factory=Tokens)


# The profiles by which documents are cut.
PROFILES = {
    "faq": Profile(320, 60, 80, ("\n\n", "\n", " "), ("summary", "text_plain", "text")),
    "policy": Profile(420, 100, 120, ("\n\nĐiều ", "\n\nKhoản ", "\n\n", "\n"), ("text", "text_plain", "summary")),
    "auto": Profile(350, 70, 100, ("\n## ", "\n### ", "\n\n", "\n", ". ", " ")),
}


def blocks(text: str) -> list[str]:
    """A text cut before its headings: lines stripped, runs of blank lines as one."""
    out: list[list[str]] = []
    for line in (x.strip() for x in text.splitlines()):
        if line and (not out or BLOCK.match(line)):
            out.append([line])
        elif line or out and out[-1][-1]:
            out[-1].append(line)
    return ["\n".join(b).strip() for b in out] or [text]


def windows(text: str, profile: Profile) -> list[str]:
    """The chunks of a text (TF1).

    A text that fits is one chunk, whatever its size. Others are packed from their blocks, or, if they have one only, from their
    parts at the first separator that they hold. What would overflow is emitted, if it has `least` tokens, and the next chunk
    starts with its last `overlap` tokens (its parts joined by nothing). Sizes are sums of parts, measured anew after an
    overflow. A part larger than a chunk isn't cut.
    """
    n = lambda s: len(profile.tokens.encode(s))
    if n(text) <= profile.size:
        return [text]
    parts, joint = blocks(text), "\n\n"
    if len(parts) <= 1:
        joint = next((s for s in profile.separators if s in text), joint)
        parts = text.split(joint)
    out, held, size = [], [], 0
    for part in filter(None, (p.strip() for p in parts)):
        more = n(part)
        if size + more > profile.size:
            out.append(joint.join(held).strip())
            tail = _tail("".join(held), profile)
            held = [tail, part] if tail else [part]
            size = n(joint.join(held))
        else:
            held.append(part)
            size += more
    out.append(joint.join(held).strip())
    return [c for c in out if c and n(c) >= profile.least]


def _tail(text: str, profile: Profile) -> str:
    if not profile.overlap:
        return ""
    tokens = profile.tokens.encode(text)
    return text if len(tokens) <= profile.overlap else profile.tokens.decode(tokens[-profile.overlap :])


def open_sections(chunk: str, above: list[str]) -> list[str]:
    """The headings that are open at a chunk's end, given those open before it: a heading closes those of its rank and below."""
    out = list(above)
    for line in (x.strip() for x in chunk.splitlines()):
        if (found := BLOCK.match(line)) and (word := line.split(maxsplit=1)[0].lower()) in LEVELS:
            rank = LEVELS.index(word)
            out = [h for h in out if LEVELS.index(h.split(maxsplit=1)[0].lower()) < rank] + [" ".join(found[0].split()[:2]).rstrip(".:")]
    return out


def profile_of(metadata: Column, text: Column) -> Column:
    """faq, policy or auto: by the metadata (a map), then by legal headings in the text (TF2)."""
    kind = F.coalesce(metadata["info_type"], F.lit(""))
    legal = F.contains(kind, F.lit("van_ban_phap_ly")) | F.contains(F.lower(kind), F.lit("policy")) | F.coalesce(metadata["legal_structure_detected"] == "true", F.lit(False))
    faq = F.coalesce(F.array_contains(F.map_keys(metadata), "faq_type"), F.lit(False))
    return F.when(faq, "faq").when(legal | F.coalesce(text.rlike(FOLD + POLICY), F.lit(False)), "policy").otherwise("auto")


CHUNKS = pa.schema([("doc_id", pa.string()), ("chunk_id", pa.int32()), ("text", pa.string()), ("profile", pa.string()), ("breadcrumbs", pa.list_(pa.string())), ("sections", pa.list_(pa.string())), ("sparse_terms", pa.list_(pa.string())), ("n_chunks", pa.int32())])
CHUNKS_SQL = "doc_id string, chunk_id int, text string, profile string, breadcrumbs array<string>, sections array<string>, sparse_terms array<string>, n_chunks int"


def terms(text: str, stop: frozenset[str] = frozenset(STOPWORDS)) -> list[str]:
    """Words of a chunk, lower case, of three letters or more, without stop words."""
    return [t for t in WORD.findall(text.lower()) if t not in stop and len(t) > 2]


def chunked(docs: DataFrame, profiles: dict[str, Profile] | None = None, profile: str = "auto") -> DataFrame:
    """Chunk rows of documents (doc_id, text, text_plain, summary, metadata: a map): id, doc_id, chunk_id, text, profile,
    breadcrumbs (the source, then the first section named in the chunk), sections (headings open where the chunk starts), sparse_terms,
    prev_chunk_id and next_chunk_id (empty at the ends) (TF3).

    With profile `auto` each document is cut by its own one. A document without any text gives no chunk. A document is cut by
    one task, in memory; documents are never gathered.
    """
    known = profiles or PROFILES
    meta = F.coalesce("metadata", F.create_map().cast("map<string,string>"))
    name = profile_of(meta, F.col("text")) if profile == "auto" else F.lit(profile)
    rows = docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text", "text_plain", "summary", meta["source"].alias("source"), name.alias("profile"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, held = [], 0
        # A few rows are Python objects at a time, and chunks go as soon as they are many.
        for row in (r for batch in batches for i in range(0, batch.num_rows, ROWS) for r in batch.slice(i, ROWS).to_pylist()):
            own = known[row["profile"]]
            text = next((row[c] for c in own.prefer if row[c]), "")
            above: list[str] = []
            parts = windows(text, own) if text.strip() else []
            for i, chunk in enumerate(parts):
                named = SECTION.search(chunk)
                crumbs = [x for x in (row["source"], named and named[0]) if x]
                out.append({"doc_id": row["doc_id"], "chunk_id": i, "text": chunk, "profile": row["profile"], "breadcrumbs": crumbs, "sections": above, "sparse_terms": terms(chunk), "n_chunks": len(parts)})
                above = open_sections(chunk, above)
                held += len(chunk)
                if held >= HELD:
                    yield pa.RecordBatch.from_pylist(out, CHUNKS)
                    out, held = [], 0
        if out:
            yield pa.RecordBatch.from_pylist(out, CHUNKS)

    cut = rows.mapInArrow(run, CHUNKS_SQL)
    at = lambda i: F.concat("doc_id", F.lit("_chunk_"), i.cast("string"))
    before, after = F.when(F.col("chunk_id") > 0, at(F.col("chunk_id") - 1)), F.when(F.col("chunk_id") + 1 < F.col("n_chunks"), at(F.col("chunk_id") + 1))
    return cut.select(at(F.col("chunk_id")).alias("id"), *[c for c in cut.columns if c != "n_chunks"], F.coalesce(before, F.lit("")).alias("prev_chunk_id"), F.coalesce(after, F.lit("")).alias("next_chunk_id"))
