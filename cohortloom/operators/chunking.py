"""Documents to paragraphs, windows and table rows.

A document arrives as one row, so numbering, packing and alignment stay inside that row and
need no shuffle; only the finished chunks are exploded.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortloom.functions.binding import let
from cohortloom.operators.filters import count_contained, skip_section

# Packing size in tokens, least overview length, character windows.
MAX_TOKENS = 600
MIN_OVERVIEW_CHARS = 100
CHILD_WINDOW = (1200, 150)
FALLBACK_WINDOW = (1800, 200)
# Phrases that mark an abstract, and words that mark an author list.
ABSTRACT_SIGNALS = ["we aimed", "this study aimed", "the aim of this", "we conducted a", "we performed a", "we evaluated",
                    "we report", "we present the results", "this phase", "this randomized", "this prospective",
                    "methods.", "results.", "conclusions.", "purpose.", "objective."]
AUTHOR_SIGNALS = ["department of", "university", "hospital", "@", "md,", "phd,", "orcid", "correspondence to"]


def word_count(text: Column) -> Column:
    """Default token count: white-space separated words."""
    return F.regexp_count(text, F.lit(r"\S+"))


def lines(text: Column, separator: str = "\n") -> Column:
    """Trimmed non-empty pieces of a text."""
    return F.filter(F.transform(F.split(text, separator), lambda p: F.trim(p)), lambda p: p != "")


def pack(pieces: Column, max_tokens: int = MAX_TOKENS, tokens: Callable[[Column], Column] = word_count) -> Column:
    """Window number of every piece; a window closes when the next piece would exceed the limit."""
    start = F.struct(F.lit(0).alias("win"), F.lit(0).alias("used"), F.array().cast("array<int>").alias("out"))

    def step(acc: Column, n: Column) -> Column:
        overflow = (acc["used"] > 0) & (acc["used"] + n > max_tokens)
        win = F.when(overflow, acc["win"] + 1).otherwise(acc["win"])
        used = F.when(overflow, n).otherwise(acc["used"] + n)
        return F.struct(win.alias("win"), used.alias("used"), F.concat(acc["out"], F.array(win)).alias("out"))

    sizes = F.transform(pieces, lambda p: tokens(p))
    return F.aggregate(sizes, start, step, lambda acc: acc["out"])


def section_windows(docs: DataFrame, key: str, text: str, max_tokens: int = MAX_TOKENS, min_chars: int = 20) -> DataFrame:
    """Windows of whole paragraphs with their first and last paragraph."""
    parts = docs.select(key, F.filter(lines(F.col(text)), lambda p: F.length(p) >= min_chars).alias("parts"))
    packed = parts.withColumn("wins", pack(F.col("parts"), max_tokens))
    rows = packed.select(key, "parts", "wins", F.explode(F.array_distinct("wins")).alias("window_idx"))
    first = F.array_position("wins", F.col("window_idx")).cast("int")
    size = F.size(F.filter("wins", lambda w: w == F.col("window_idx")))
    members = F.slice("parts", first, size)
    return rows.select(
        key, "window_idx", (first - 1).alias("first_par"), (first + size - 2).alias("last_par"),
        F.array_join(members, "\n\n").alias("text"), members.alias("members"),
    )


def window_texts(parts: Column, wins: Column) -> Column:
    """Joined text of every window of :func:`pack`, still inside the document row."""
    return let(
        F.struct(parts.alias("p"), wins.alias("w")),
        lambda v: F.transform(
            F.array_distinct(v["w"]),
            lambda n: F.array_join(F.slice(v["p"], F.array_position(v["w"], n).cast("int"), F.size(F.filter(v["w"], lambda x: x == n))), "\n\n"),
        ),
    )


def number_paragraphs(docs: DataFrame, key: str, sections: str) -> DataFrame:
    """Sentences with document-wide paragraph and sentence ids and the "Section.N" reference.

    ``sections`` is array<struct<name, content>>; paragraphs end at blank lines.
    """

    def paragraphs(s: Column) -> Column:
        name = F.trim(F.regexp_replace(F.trim(s["name"]), "^#+", ""))
        return F.transform(
            lines(s["content"], "\n\n"),
            lambda p, i: F.struct(s["name"].alias("section"), (i + 1).alias("num"), F.concat_ws(".", name, (i + 1).cast("string")).alias("ref"), p.alias("text")),
        )

    numbered = docs.select(key, F.flatten(F.transform(sections, paragraphs)).alias("pars"))
    marked = lambda t: F.split(F.regexp_replace(t, r"([.!?])\s+", "$1\u0001"), "\u0001")
    sentences = F.flatten(
        F.transform(
            "pars",
            lambda p, i: F.transform(
                F.filter(marked(p["text"]), lambda t: F.trim(t) != ""),
                lambda t: F.struct(i.alias("paragraph_id"), p["ref"].alias("paragraph_ref"), p["num"].alias("section_paragraph_num"), F.trim(t).alias("sentence")),
            ),
        )
    )
    return numbered.select(key, F.posexplode(sentences).alias("sentence_id", "s")).select(key, "sentence_id", "s.*")


def text_clean(text: Column) -> Column:
    """Footnote marks, line breaks and LaTeX removed, long gaps folded."""
    out = F.regexp_replace(text, r"\[\^\d+\]", "")
    out = F.regexp_replace(out, r"<br\s*/?>", "\n")
    out = F.regexp_replace(out, r"\\(?:mathrm|text|textbf|textit)\{([^}]*)\}", "$1")
    out = F.regexp_replace(out, r"\$([^$]*)\$", "$1")
    out = F.regexp_replace(out, r"\\%", "%")
    out = F.regexp_replace(out, r"\\[a-zA-Z]+", "")
    return F.trim(F.regexp_replace(out, r"\s{3,}", "\n\n"))


def overview_chunk(docs: DataFrame, key: str, sections: str, max_chars: int | None = None, head_chars: int | None = None) -> DataFrame:
    """The headed content sections, and whether the first is an abstract.

    ``max_chars`` ends the overview there, ``head_chars`` limits what is judged of a section; by default all counts.
    """

    def judged(text: Column) -> Column:
        return F.substring(text, 1, head_chars) if head_chars else text

    content = F.filter(
        sections,
        lambda s: (F.trim(s["content"]) != "") & ~skip_section(s["name"], s["content"], head_chars)
        & let(F.lower(judged(s["content"])), lambda head: count_contained(head, AUTHOR_SIGNALS) < 3),
    )
    docs, kept = docs.select(key, content.alias("kept")), F.col("kept")
    headed = F.transform(kept, lambda s: F.concat(F.lit("## "), F.trim(F.regexp_replace(F.trim(s["name"]), "^#+", "")), F.lit("\n\n"), F.trim(s["content"])))
    joined = F.array_join(headed, "\n\n")
    overview = F.trim(F.substring(joined, 1, max_chars) if max_chars else joined)
    first = F.lower(judged(F.get(kept, F.lit(0))["content"]))
    rows = docs.select(
        key, F.size(kept).alias("sections_used"), overview.alias("overview"),
        F.coalesce(count_contained(first, ABSTRACT_SIGNALS) >= 2, F.lit(False)).alias("first_is_abstract"),
    )
    return rows.filter(F.length("overview") >= MIN_OVERVIEW_CHARS).withColumn("overview", text_clean(F.col("overview")))


def char_windows(docs: DataFrame, key: str, text: str, size: int = FALLBACK_WINDOW[0], overlap: int = FALLBACK_WINDOW[1]) -> DataFrame:
    """K7: overlapping character windows; the last one ends with the text."""
    clean = F.trim(F.col(text))
    n = F.length(clean)
    count = F.when(n <= size, 1).otherwise(F.ceil((n - size) / (size - overlap)).cast("int") + 1)
    rows = docs.select(key, clean.alias("body"), F.explode(F.sequence(F.lit(0), count - 1)).alias("chunk_index")).filter(F.col("body") != "")
    return rows.select(key, "chunk_index", F.substring("body", F.col("chunk_index") * (size - overlap) + 1, F.lit(size)).alias("text"))


def table_row_text(number: Column, title: Column, headers: Column, cells: Column) -> Column:
    """I35: "Table N - title. h: v; h: v"; headers only when the counts agree; NULL below 20 characters."""
    named = F.array_join(F.zip_with(headers, cells, lambda h, v: F.concat(h, F.lit(": "), v)), "; ")
    body = F.when((F.size(headers) > 0) & (F.size(headers) == F.size(cells)), named).otherwise(F.array_join(cells, "; "))
    text = F.trim(F.concat(number, F.lit(" - "), title, F.lit(". "), body))
    return F.when(F.length(text) >= 20, text)


def table_to_map(headers: Column, cells: Column) -> Column:
    """The cells of a row after its label, keyed by their headers."""
    width = F.least(F.size(headers), F.size(cells))
    entries = F.transform(F.sequence(F.lit(1), width - 1), lambda i: F.struct(F.get(headers, i).alias("key"), F.get(cells, i).alias("value")))
    return F.when(width > 1, F.map_from_entries(entries)).otherwise(F.map_from_entries(F.array().cast("array<struct<key:string,value:string>>")))


def term_rollup(chunks: DataFrame, key: str, terms: str) -> DataFrame:
    """Sorted distinct lower-cased terms per study; repeats fall away before a study is gathered."""
    rows = chunks.select(key, F.explode(F.array_distinct(F.transform(terms, lambda t: F.lower(F.trim(t))))).alias("term"))
    distinct = rows.filter(F.col("term") != "").distinct()
    return distinct.groupBy(key).agg(F.array_sort(F.collect_list("term")).alias("terms"))


def rollup_stats(df: DataFrame, terms: str) -> DataFrame:
    """Studies, studies with terms, average and largest number of terms."""
    n = F.coalesce(F.size(terms), F.lit(0))
    return df.agg(
        F.count(F.lit(1)).alias("total"), F.count_if(n > 0).alias("with_terms"),
        F.avg(F.when(n > 0, n)).alias("avg_terms"), F.max(n).alias("max_terms"),
    )


def keyword_union(windows: DataFrame, key: str, members: str, keywords: Callable[[Column], Column]) -> DataFrame:
    """Sorted union of the keywords of a window's members, flat and by first letter."""
    union = F.array_sort(F.array_distinct(F.flatten(F.transform(members, keywords))))
    return windows.select(key, "window_idx", union.alias("keywords"))


def doc_level_inherit(chunks: DataFrame, doc: str, is_overview: Column, order: Column, tags: str) -> DataFrame:
    """The tags of a document's overview chunk on all its chunks."""
    heads = chunks.filter(is_overview).groupBy(doc).agg(F.min_by(tags, order).alias(f"doc_level_{tags}"))
    return chunks.join(heads, doc, "left")


def section_align(docs: DataFrame, key: str, chunks: str, sections: str) -> DataFrame:
    """Best section per chunk by name, shared 5-word shingles or whole containment; below 50 points none.

    ``chunks`` is array<string>, ``sections`` array<struct<name, content>> of the same document. Whole texts are
    compared: shingles are hashed once per text, and two texts meet in one hashed intersection.
    """

    def clean(t: Column) -> Column:
        low = F.regexp_replace(F.lower(t), r"\$[^$]*\$|\\[a-zA-Z]+\{[^}]*\}|\\[a-zA-Z]+|#{1,6}\s*|<[^>]+>|\[\^?\d+\]", "")
        return F.regexp_replace(F.trim(F.regexp_replace(low, r"\s+", " ")), "[^a-z0-9 ]", "")

    def shingles(body: Column) -> Column:
        none = F.array().cast("array<bigint>")

        def grams(words: Column) -> Column:
            made = F.transform(F.sequence(F.lit(1), F.greatest(F.size(words) - 4, F.lit(1))), lambda i: F.xxhash64(F.slice(words, i, 5)))
            return F.when((F.size(words) >= 5) & (F.length(body) >= 20), F.array_distinct(made)).otherwise(none)

        return let(F.filter(F.split(body, " "), lambda w: w != ""), grams)

    cleaned = docs.select(
        key,
        F.transform(chunks, clean).alias("chunk_clean"),
        F.transform(sections, lambda s: F.struct(s["name"].alias("name"), clean(s["name"]).alias("name_clean"), clean(s["content"]).alias("body"))).alias("secs"),
    )
    numbered = F.transform("chunk_clean", lambda c, i: F.struct(i.alias("i"), c.alias("c"), shingles(c).alias("grams")))
    prepared = cleaned.select(
        key,
        F.filter(numbered, lambda e: F.length(e["c"]) >= 20).alias("own"),
        F.transform("secs", lambda s: F.struct(s["name"], s["name_clean"], s["body"], shingles(s["body"]).alias("grams"))).alias("secs"),
    )

    def score(chunk: Column, s: Column) -> Column:
        by_name = F.when((F.length(s["name_clean"]) >= 4) & chunk["c"].contains(s["name_clean"]), 100 + F.length(s["name_clean"])).otherwise(0)
        by_shingle = let(F.size(F.array_intersect(chunk["grams"], s["grams"])), lambda found: F.when(found >= 2, 50 + found * 10).otherwise(0))
        by_text = F.when((F.length(s["body"]) >= 30) & chunk["c"].contains(s["body"]), 80 + F.length(s["body"])).otherwise(0)
        return F.greatest(by_name, by_shingle, by_text)

    def align(secs: Column) -> Column:
        return F.transform(
            "own",
            lambda e: F.struct(
                e["i"].alias("chunk_idx"),
                F.array_max(F.transform(secs, lambda s, j: F.struct(score(e, s).alias("score"), (-j).alias("ord"), s["name"].alias("name")))).alias("m"),
            ),
        )

    best = let(F.col("secs"), align)
    rows = prepared.select(key, F.explode(best).alias("b")).select(key, "b.chunk_idx", F.col("b.m.score").alias("score"), F.col("b.m.name").alias("section"))
    return rows.filter(F.col("score") >= 50)
