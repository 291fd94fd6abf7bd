"""Documents to hierarchical chunks (inventory section 3).

A document is one row, so cleaning and splitting need no shuffle: one pass of
Arrow batches. Order, links and counts over chunks are windows.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillgraph.operators.graph import stack_parents

MAX_CHARS, OVERLAP, MAX_DEPTH = 2000, 200, 3
SEPARATORS = ("\n\n", "\n", ". ", "; ", ", ", " ")
HEADING = re.compile(r"^(#{1,6})\s+(.*)$")
MARKUP = re.compile(r"[*_#`]")
PAGE_NUMBER = re.compile(r"^\s*(?:\d{1,3}|[ivxlcdm]+)\s*$", re.I)
TOC_LINE = re.compile(r"^.*?(?:\.{3,}|…{1,})\s*\d+\s*$")
NUMBERED = re.compile(r"^(?:\*\*)?(\d+(?:\.\d+){0,3})\.?\s*(?:\*\*)?\s+(?:\*\*)?([A-Z][^.:;?!]{2,58})(?:\*\*)?$")
FIGURE = re.compile(r"^\s*[*_]*(Figure\s+\d+[^\n]*)$", re.I)
PAGE = re.compile(r"<!-- Page (\d+) -->")
ROW = re.compile(r"^\s*\|.*\|\s*$")
NEW_TEXT = re.compile(r"^(?!http|e\.g\.|i\.e\.)[a-z]")


# --- cleaning ----------------------------------------------------------------


def repeated_lines(lines: list[str], least: int = 3) -> set[str]:
    """Running headers and footers: lines of 2 to 12 words seen ``least`` times, markup aside."""
    bare = [MARKUP.sub("", x).strip() for x in lines if not x.startswith("#")]
    seen = Counter(x for x in bare if len(x) >= 3 and not x.startswith(("|", "---")))
    return {x for x, n in seen.items() if n >= least and 2 <= len(x.split()) <= 12}


def clean(text: str) -> str:
    """A document's text without running heads, page numbers, contents lines and broken lines."""
    lines = unicodedata.normalize("NFKC", text).split("\n")
    repeated = repeated_lines(lines)
    lines = [x for x in lines if x.startswith("#") or MARKUP.sub("", x).strip() not in repeated]
    blank = lambda i: not (0 <= i < len(lines)) or not lines[i].strip()
    lines = [x for i, x in enumerate(lines) if not (PAGE_NUMBER.match(x) and (blank(i - 1) or blank(i + 1)))]
    lines = [x for x in lines if not TOC_LINE.match(x)]
    lines = [f"[图: {MARKUP.sub('', m[1]).strip()}]" if (m := FIGURE.match(x)) else x for x in lines]
    return re.sub(r"\n{3,}", "\n\n", "\n".join(rejoin(lines)))


def rejoin(lines: list[str]) -> list[str]:
    """Lines that go on in lower case are put behind the line they break off from."""
    kept: list[str] = []
    for line in lines:
        last = next((i for i in range(len(kept) - 1, -1, -1) if kept[i].strip()), None)
        if last is not None and NEW_TEXT.match(line):
            before = kept[last].rstrip()
            if not before.startswith(("#", "|", "---")) and before[-1] not in ".:;?!)|":
                kept[last:] = [f"{before} {line}"]
                continue
        kept.append(line)
    return kept


def promote(line: str) -> str:
    """A numbered title as a heading; its level is the number of number parts, three at most."""
    if line.startswith("#") or not (m := NUMBERED.match(line.strip())):
        return line
    return f"{'#' * min(len(m[1].split('.')), MAX_DEPTH)} {m[1]} {m[2].strip('* ')}"


# --- segments -----------------------------------------------------------------


@dataclass
class Segment:
    """A heading with the text under it."""

    level: int
    heading: str
    parents: list[str] = field(default_factory=list)
    lines: list[str] = field(default_factory=list)


def segments(text: str) -> list[Segment]:
    """Text cut at headings; what comes before the first is ``(Preamble)`` at level 0."""
    found, stack = [Segment(0, "(Preamble)")], []
    for line in text.split("\n"):
        m = HEADING.match(line)
        if not m:
            found[-1].lines.append(line)
            continue
        level = min(len(m[1]), MAX_DEPTH)
        title = re.sub(r"[.…\s]*\d*\s*$", "", MARKUP.sub("", m[2])).strip() or MARKUP.sub("", m[2]).strip()
        while stack and stack[-1][0] >= level:
            stack.pop()
        found.append(Segment(level, title, [t for _, t in stack if t]))
        stack.append((level, title))
    return [s for s in found if s.level or any(x.strip() for x in s.lines)]


def pull_tables(lines: list[str]) -> tuple[list[str], list[str]]:
    """Markdown tables out of lines: a short placeholder with up to five column names stays."""
    text, tables, i = [], [], 0
    while i < len(lines):
        if ROW.match(lines[i]) and i + 1 < len(lines) and re.match(r"^\s*\|[\s:|-]+\|\s*$", lines[i + 1]):
            j = i
            while j < len(lines) and ROW.match(lines[j]):
                j += 1
            names = [c.strip() for c in lines[i].strip().strip("|").split("|")]
            names = [n for n in names if n and not re.fullmatch(r"Col\d+", n)]
            text.append(f"[表: {', '.join(names[:5])}]")
            tables.append("\n".join(lines[i:j]))
            i = j
        else:
            text.append(lines[i])
            i += 1
    return text, tables


# --- splitting ------------------------------------------------------------------


def split_text(text: str, size: int = MAX_CHARS, separators: tuple[str, ...] = SEPARATORS) -> list[str]:
    """Parts of at most ``size`` characters, packed greedily at the coarsest separator that works."""
    if len(text) <= size:
        return [text]
    if not separators:
        return force_split(text, size)
    out, held = [], ""
    for piece in text.split(separators[0]):
        joined = f"{held}{separators[0]}{piece}" if held else piece
        if len(joined) <= size:
            held = joined
            continue
        if held:
            out.append(held)
        parts = split_text(piece, size, separators[1:])
        out += parts[:-1]
        held = parts[-1]
    return [*out, held] if held else out


def force_split(text: str, size: int) -> list[str]:
    """Parts of ``size`` characters, moved back to white space where there is any."""
    out = []
    while len(text) > size:
        cut = text.rfind(" ", 1, size + 1)
        cut = cut if cut > 0 else size
        out.append(text[:cut].rstrip())
        text = text[cut:].lstrip()
    return [*out, text] if text else out


def with_overlap(parts: list[str], size: int = OVERLAP) -> list[str]:
    """Each part after the end of the one before, from a sentence start within the last ``size`` characters."""
    out = parts[:1]
    for before, part in zip(parts, parts[1:], strict=False):
        tail = before[-size:]
        start = re.search(r"(?:[.!?]\s+(?=[A-Z])|\n\n|[.!?]\s+|\n(?=[A-Z])|\s)", tail)
        prefix = tail[start.end() :] if start and len(tail) - start.end() >= 20 else ""
        out.append(f"{prefix}\n{part}" if prefix else part)
    return out


CHUNK = (
    "doc_id string, seq int, chunk_id string, level int, heading string, parents_context string, content string, "
    "search_text string, page_hint int, has_table boolean, table_refs array<string>, char_count int, line_count int"
)


def chunk_text(doc_id: str, text: str) -> list[dict]:
    """The chunks of one document, in order."""
    lines = [promote(x) for x in clean(text).split("\n")]
    rows: list[dict] = []
    for s in segments("\n".join(lines)):
        body, tables = pull_tables(s.lines)
        page = next((int(m[1]) for x in s.lines if (m := PAGE.search(x))), None)
        parents, taken = " > ".join(s.parents), 0
        for part in with_overlap(split_text("\n".join(body).strip())):
            if not part.strip() and not s.heading:
                continue
            n = part.count("[表:")
            refs, taken = tables[taken : taken + n], taken + n
            seq = len(rows) + 1
            search = re.sub(r"\[\d+\]", "", "\n".join(x for x in (parents, s.heading, part) if x))
            rows.append(
                {
                    "doc_id": doc_id, "seq": seq, "chunk_id": f"{doc_id}_C{seq:04d}_{hashlib.md5(part.encode()).hexdigest()[:8]}",
                    "level": s.level, "heading": s.heading, "parents_context": parents, "content": part, "search_text": search,
                    "page_hint": page, "has_table": bool(refs), "table_refs": refs, "char_count": len(part), "line_count": part.count("\n") + 1,
                }
            )
    return rows


def chunk_documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All chunks of all documents; a null text counts as empty and gives none."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [f.split()[0] for f in CHUNK.split(", ")]
        for pdf in batches:
            rows = [r for d, t in zip(pdf["id"], pdf["text"], strict=True) for r in chunk_text(str(d), t or "")]
            out = pd.DataFrame(rows, columns=names)
            yield out.astype({"page_hint": "Int32"})

    return df.select(F.col(id_col).cast("string").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).mapInPandas(run, CHUNK)


def linked_chunks(chunks: DataFrame) -> DataFrame:
    """Adds prev/next chunk ids and the number of direct children."""
    order = Window.partitionBy("doc_id").orderBy("seq")
    linked = chunks.withColumn("prev_chunk_id", F.lag("chunk_id").over(order)).withColumn("next_chunk_id", F.lead("chunk_id").over(order))
    # levels begin at 0; a child stands one level below the nearest row before it with a smaller level
    rows = linked.select("doc_id", "seq", (F.col("level") + 1).alias("depth"))
    under = stack_parents(rows, "doc_id", "seq", "depth", "seq", MAX_DEPTH + 2).where("parent IS NOT NULL")
    above = rows.select("doc_id", F.col("seq").alias("parent"), F.col("depth").alias("parent_depth"))
    children = under.join(above, ["doc_id", "parent"]).where("depth = parent_depth + 1").groupBy("doc_id", F.col("parent").alias("seq")).agg(F.count(F.lit(1)).cast("int").alias("children_count"))
    return linked.join(children, ["doc_id", "seq"], "left").withColumn("children_count", F.coalesce("children_count", F.lit(0)))


def longest_contents(chunks: DataFrame) -> DataFrame:
    """Per chunk id the longest content, the earlier on a tie; blank ones go."""
    order = Window.partitionBy("chunk_id").orderBy(F.length("content").desc(), "doc_id", "seq")
    best = chunks.where(F.trim("content") != "").withColumn("__n", F.row_number().over(order))
    return best.where("__n = 1").drop("__n")


def corpus_summary(chunks: DataFrame) -> DataFrame:
    """Chunks and level histogram per document."""
    return chunks.groupBy("doc_id", "level").agg(F.count(F.lit(1)).alias("chunks"), F.max("char_count").alias("longest"))
