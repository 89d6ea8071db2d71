"""Text functions as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that the lexical index leaves out.
STOPWORDS = (
    "a an and are as at be by for from has have how in is it its of on or that the this to was what "
    "when where which who why will with does do did can should would there these those"
).split()

# Words that keyword extraction leaves out when no list is given.
KEYWORD_STOPWORDS = tuple(
    """
    a about above after again all am an and any are as at be because been before being below between both but by
    can did do does doing down during each few for from further had has have having he her here hers herself him
    himself his how i if in into is it its itself just me more most my myself no nor not now of off on once only or
    other our ours ourselves out over own s same she should so some such t than that the their theirs them
    themselves then there these they this those through to too under until up very was we were what when where
    which while who whom why will with you your yours yourself yourselves
    """.split()
)
SPACE = r"(?U)[\s\x1c-\x1f]+"
TABLE_CAPTION = r"(?i)^\s*(table|tbl\.?|exhibit)"
FIGURE_CAPTION = r"(?i)^\s*(figure|fig\.?)"


def blank_to_null(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def collapse(c: Column) -> Column:
    """Runs of Unicode white space become one blank; the ends are trimmed."""
    return F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), SPACE, " "))


def strip(c: Column) -> Column:
    return F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", "")


def tokenize(c: Column) -> Column:
    """Lower-case terms of [a-z0-9_], longer than one, no stopwords; duplicates stay."""
    terms = F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit("[a-z0-9_]+"), F.lit(0))
    return F.filter(terms, lambda t: (F.length(t) > 1) & ~t.isin(*STOPWORDS))


def boilerplate_key(c: Column) -> Column:
    """Text that only differs in numbers, case and spacing has one key."""
    return F.regexp_replace(F.lower(collapse(c)), r"(?U)\d+", "#")


def stop_union(*lists: tuple[str, ...]) -> tuple[str, ...]:
    """The words of all lists, each once, in the order of their first appearance."""
    return tuple(dict.fromkeys(w for words in lists for w in words))


def shown_score(c: Column) -> Column:
    """A score as it is shown: four decimals."""
    return F.round(c, 4)


def keywords(c: Column, limit: int = 40, stop: tuple[str, ...] = KEYWORD_STOPWORDS) -> Column:
    words = F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(r"[A-Za-z][A-Za-z0-9\-_/%.]*"), F.lit(0))
    words = F.transform(words, lambda w: F.lower(F.regexp_replace(w, r"^[.\-_/]+|[.\-_/]+$", "")))
    return F.slice(F.array_distinct(F.filter(words, lambda w: (F.length(w) >= 3) & ~w.isin(*stop) & w.rlike("[a-z]"))), 1, limit)


def first_sentence(c: Column, limit: int = 200) -> Column:
    flat = collapse(c)
    head = F.split_part(flat, F.lit(". "), F.lit(1))
    cut = F.concat(F.rtrim(F.left(head, F.lit(limit))), F.lit("."))
    return F.when(flat == "", F.lit("")).when(F.length(head) > limit, cut).otherwise(F.concat(F.regexp_replace(head, r"\.+$", ""), F.lit(".")))


def snippet(body: Column, size: int = 400) -> Column:
    return F.left(collapse(body), F.lit(size))


def body(core_text: Column, text: Column) -> Column:
    return F.coalesce(blank_to_null(core_text), text)


def document_input(title: Column, text: Column) -> Column:
    """The prompt under which a chunk is encoded."""
    return F.concat(F.lit("title: "), F.coalesce(blank_to_null(strip(title)), F.lit("none")), F.lit(" | text: "), F.coalesce(text, F.lit("")))


def query_input(text: Column) -> Column:
    """The prompt under which a query is encoded."""
    return F.concat(F.lit("task: search result | query: "), text)


def descriptor(title: Column, caption: Column, words: Column, chunk_type: Column) -> Column:
    return F.trim(F.concat_ws(" ", blank_to_null(title), blank_to_null(caption), blank_to_null(F.translate(words, ",", " ")), blank_to_null(chunk_type)))


def rerank_text(title: Column, text: Column) -> Column:
    return F.concat_ws("\n", blank_to_null(title), text)


def digest_id(*parts: Column, size: int = 16) -> Column:
    """A reproducible id: the first hex digits of a SHA-256."""
    return F.left(F.sha2(F.concat_ws("|", *parts), 256), F.lit(size))


def shorten(text: str, width: int, placeholder: str = " ...") -> str:
    """Cut at a word boundary for display."""
    import textwrap

    return textwrap.shorten(" ".join((text or "").split()), width, placeholder=placeholder)


def strip_prompt_echo(c: Column, prompt: str, markers: tuple[str, ...]) -> Column:
    """What follows the last marker, without the prompt and leading colons."""
    for m in markers:
        c = F.substring_index(c, m, -1)
    return F.regexp_replace(strip(F.replace(c, F.lit(prompt), F.lit(""))), r"^[:\s]+", "")


def table_cell(c: Column) -> Column:
    return F.replace(collapse(c), F.lit("|"), F.lit("\\|"))


def rows_to_markdown(rows: Column, drop_blank: bool = True) -> Column:
    """A table of rows of cells as Markdown; short rows are padded, the first row is the header."""
    clean = F.transform(F.coalesce(rows, F.array().cast("array<array<string>>")), lambda r: F.transform(r, table_cell))
    if drop_blank:
        clean = F.filter(clean, lambda r: F.exists(r, lambda x: x != ""))
    wide = F.aggregate(clean, F.lit(0), lambda a, r: F.greatest(a, F.size(r)))
    line = lambda cells: F.concat(F.lit("| "), F.array_join(cells, " | "), F.lit(" |"))
    # the width is handed to the rows: within their lambda it would be worked out, over all rows, for each of them
    lines = F.zip_with(clean, F.array_repeat(wide, F.size(clean)), lambda r, w: line(F.concat(r, F.array_repeat(F.lit(""), w - F.size(r)))))
    rule = line(F.array_repeat(F.lit("---"), wide))
    return F.when(F.size(clean) == 0, F.lit("")).otherwise(F.array_join(F.array_insert(lines, 2, rule), "\n"))
