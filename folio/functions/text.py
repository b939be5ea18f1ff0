"""Column functions on titles, ids, dates, names, messages, pages and paragraphs."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from folio.functions import rules

#: Month abbreviations of feed dates, months of spoken dates.
MONTHS = ("January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December")
#: HTML and XML entities in the order in which they are decoded (so `&amp;lt;` becomes `<`).
ENTITIES = (("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"))
#: Markup of abstracts to plain text, in order.
ABSTRACT_MARKUP = [
    (r"\$([^$]*)\$", r"\1"),
    (r"\\(?:textit|textbf|textsc|textrm|textsf|texttt|emph|text|mathrm|mathbf|mathit|mathcal|mathbb)\{([^}]*)\}", r"\1"),
    (r"\\href\{[^}]*\}\{([^}]*)\}", r"\1"), (r"\\url\{([^}]*)\}", r"\1"), (r"\\(?:cite|ref|label|eqref|cref|Cref)\{[^}]*\}", ""),
    (r"\\pm\b", "±"), (r"\\times\b", "×"), (r"\\approx\b", "≈"), (r"\\leq?\b", "≤"), (r"\\geq?\b", "≥"), (r"\\neq\b", "≠"), (r"\\infty\b", "∞"),
    (r"\\alpha\b", "α"), (r"\\beta\b", "β"), (r"\\gamma\b", "γ"), (r"\\delta\b", "δ"), (r"\\epsilon\b", "ε"), (r"\\lambda\b", "λ"), (r"\\mu\b", "μ"),
    (r"\\pi\b", "π"), (r"\\sigma\b", "σ"), (r"\\theta\b", "θ"), (r"\\omega\b", "ω"), (r"\\ldots\b", "…"), (r"\\cdots?\b", "…"),
    (r"\\&", "&"), (r"\\%", "%"), (r"\\\$", "$"), (r"\\#", "#"), (r"\\_", "_"), (r"\\[a-zA-Z]+\{([^}]*)\}", r"\1"), (r"\\[a-zA-Z]+\b", ""),
    (r"``", "“"), (r"''", "”"), (r"`", "‘"), (r"[{}]", ""), (r"\s+", " "),
]
#: Words of messages that decide an error's category, in order of precedence.
RATE_WORDS, IMAGE_WORDS, TIME_WORDS = ("429", "rate limit", "rate_limit", "too many requests"), ("decompression", "dimension", "pixel", "exceed"), ("timeout", "timed out")


#: Results that are held as Python objects before they go to Arrow's memory.
PIECE_ROWS = 64


def arrow_results(made: Iterable, kind: pa.DataType) -> pa.Array:
    """Results as an Arrow array, built in pieces: only a piece of them is ever held as Python objects."""
    pieces, held = [], []
    for x in made:
        held.append(x)
        if len(held) == PIECE_ROWS:
            pieces.append(pa.array(held, kind))
            held = []
    return pa.concat_arrays([*pieces, pa.array(held, kind)])


def mapped(texts: pa.Array, step: Callable[[str], object], kind: pa.DataType | None = None) -> pa.Array:
    """step of each text, null for null. A batch's texts stay in Arrow's memory but for the one at hand."""
    return arrow_results((None if (t := x.as_py()) is None else step(t) for x in texts), kind or pa.string())


def abs_url(paper_id: Column) -> Column:
    """The abstract page of a paper."""
    return F.concat(F.lit("https://arxiv.org/abs/"), paper_id)


def paper_id(text: Column) -> Column:
    """The first paper id in a text, new style before old style, without version; null if none."""
    new, old = (F.regexp_extract(text, p, 1) for p in (r"(\d{4}\.\d{4,5})(v\d+)?", r"(?i)([a-z-]+/\d{7})(v\d+)?"))
    return F.when(new != "", new).when(old != "", old)


def import_ids(text: Column) -> Column:
    """Distinct paper ids of a pasted list (blanks, commas, semicolons), in order; array."""
    parts = F.filter(F.split(text, r"[\s,;]+"), lambda p: p != "")
    return F.array_distinct(F.filter(F.transform(parts, paper_id), lambda p: p.isNotNull()))


def feed_date(raw: Column) -> Column:
    """`27 Mar 2024` somewhere in the text as 2024-03-27; other texts unchanged."""
    pattern = r"(\d{1,2})\s+(Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)\s+(\d{4})"
    part = lambda i: F.regexp_extract(raw, pattern, i)
    number = F.array_position(F.array(*[F.lit(m[:3]) for m in MONTHS]), part(2)).cast("string")
    return F.when(part(3) == "", raw).otherwise(F.concat_ws("-", part(3), F.lpad(number, 2, "0"), F.lpad(part(1), 2, "0")))


def spoken_date(date: Column) -> Column:
    """2024-03-07 as `March 7, 2024`; anything else unchanged."""
    day = F.try_to_date(F.when(F.trim(date).rlike(r"^\d{4}-\d{1,2}-\d{1,2}$"), F.trim(date)), "yyyy-M-d")
    return F.coalesce(F.date_format(day, "MMMM d, yyyy"), date)


def id_date(stem: Column) -> Column:
    """`Month 20YY` of an id YYMM.number in a file name, else the empty string."""
    month = F.regexp_extract(stem, r"(\d{2})(\d{2})\.\d{4,5}", 2)
    year = F.regexp_extract(stem, r"(\d{2})(\d{2})\.\d{4,5}", 1)
    name = F.get(F.array(*[F.lit(m) for m in MONTHS]), F.when(month != "", month).cast("int") - 1)
    return F.coalesce(F.when(month != "", F.concat(name, F.lit(" 20"), year)), F.lit(""))


def with_period(text: Column) -> Column:
    return F.when(text.endswith("."), text).otherwise(F.concat(text, F.lit(".")))


def spoken_authors(authors: Column) -> Column:
    """`By A, B, and C.`, with the rest counted; names lose final periods. Null for none."""
    names = F.transform(authors, lambda a: F.regexp_replace(a, r"\.+$", ""))
    n, name = F.size(names), lambda i: F.get(names, F.lit(i))
    more = n - 3
    return (
        F.when(n == 1, F.concat(F.lit("By "), name(0), F.lit(".")))
        .when(n == 2, F.concat(F.lit("By "), name(0), F.lit(" and "), name(1), F.lit(".")))
        .when(n == 3, F.concat(F.lit("By "), name(0), F.lit(", "), name(1), F.lit(", and "), name(2), F.lit(".")))
        .when(n > 3, F.concat(F.lit("By "), name(0), F.lit(", "), name(1), F.lit(", "), name(2), F.lit(", and "), more.cast("string"), F.when(more == 1, " more author.").otherwise(" more authors.")))
    )


def script(body: Column, title: Column, authors: Column, date: Column, narrator: str) -> Column:
    """A spoken script: header, body, footer. Missing title: Untitled; missing authors or date are left out."""
    name, by, on = with_period(F.when(F.coalesce(title, F.lit("")) == "", "Untitled").otherwise(title)), spoken_authors(authors), F.when(F.coalesce(date, F.lit("")) != "", F.concat(F.lit("Published on "), spoken_date(date), F.lit(".")))
    header = F.array_join(F.transform(F.array_compact(F.array(name, by, on)), lambda x: F.concat(x, F.lit("\n"))), "\n")
    footer = F.concat_ws(" ", F.concat(F.lit("Thanks for listening. This has been an audio narration of "), name), by, on, F.lit(f"Narrated by {narrator}."))
    return F.concat(header, F.lit("\n"), F.trim(body), F.lit("\n\n"), footer)


def legacy_header(title: Column, authors: Column) -> Column:
    """The older header: title and authors, each on a line, what is missing left out."""
    lines = F.array_compact(F.array(with_period(F.when(F.coalesce(title, F.lit("")) == "", "Untitled").otherwise(title)), spoken_authors(authors)))
    return F.array_join(F.transform(lines, lambda x: F.concat(x, F.lit("\n"))), "")


def short_authors(authors: Column) -> Column:
    """`A, B, C + N more`."""
    shown = F.array_join(F.slice(authors, 1, 3), ", ")
    return F.when(F.size(authors) > 3, F.concat(shown, F.lit(" + "), (F.size(authors) - 3).cast("string"), F.lit(" more"))).otherwise(shown)


def duration(seconds: Column) -> Column:
    """`1h 5m`, `5m`; null for none."""
    hours, minutes = F.floor(seconds / 3600), F.floor(seconds % 3600 / 60)
    return F.when(hours > 0, F.concat(hours.cast("string"), F.lit("h "), minutes.cast("string"), F.lit("m"))).when(seconds.isNotNull(), F.concat(minutes.cast("string"), F.lit("m")))


def age(seconds: Column) -> Column:
    """The largest of years, days, hours, minutes: `3d`."""
    out = F.concat(F.floor(seconds / 60).cast("string"), F.lit("m"))
    for size, unit in ((3600, "h"), (86400, "d"), (31536000, "y")):
        out = F.when(seconds >= size, F.concat(F.floor(seconds / size).cast("string"), F.lit(unit))).otherwise(out)
    return out


def output_name(date: Column, minutes: Column, author: Column, title: Column, stem: Column) -> Column:
    """`DATE - 12m - Author - Title - stem.mp3`, leaving out what is missing."""
    safe = lambda c, n: F.trim(F.regexp_replace(F.substring(c, 1, n), "[^A-Za-z0-9 _-]", ""))
    known = lambda c: F.when(c != "", c)
    return F.concat(F.concat_ws(" - ", known(date), F.concat(minutes.cast("string"), F.lit("m")), known(safe(author, 40)), known(safe(title, 60)), stem), F.lit(".mp3"))


def decode_entities(text: Column) -> Column:
    """XML entities decoded one kind after the other."""
    for name, char in ENTITIES:
        text = F.replace(text, F.lit(name), F.lit(char))
    return text


#: Where the rules of commands stand in ABSTRACT_MARKUP: all of them begin with a backslash.
_COMMANDS = slice(1, 1 + sum(p.startswith(r"\\") for p, _ in ABSTRACT_MARKUP))


def plain_abstract(text: Column) -> Column:
    """TeX markup of an abstract to readable text. Texts without a backslash are spared the rules of commands."""
    text = rules.column(text, ABSTRACT_MARKUP[: _COMMANDS.start])
    text = F.when(text.contains("\\"), rules.column(text, ABSTRACT_MARKUP[_COMMANDS])).otherwise(text)
    return F.trim(rules.column(text, ABSTRACT_MARKUP[_COMMANDS.stop :]))


def strip_html(html: Column) -> Column:
    """Tags removed, entities decoded (numeric ones of printable ASCII too), TeX markup cleaned."""
    text = numbered = F.regexp_replace(html, "<[^>]+>", "")
    for code in range(32, 127):
        if code not in (38,):
            numbered = F.replace(numbered, F.lit(f"&#{code};"), F.lit(chr(code)))
    text = F.when(text.contains("&#"), numbered).otherwise(text)
    return plain_abstract(F.replace(decode_entities(F.replace(text, F.lit("&#38;"), F.lit("&"))), F.lit("&nbsp;"), F.lit(" ")))


def error_category(message: Column, stage: Column) -> Column:
    """The category of an error message; the stage if its words tell nothing."""
    low = F.lower(message)
    has = lambda words: F.array_contains(F.array(*[low.contains(w) for w in words]), True)
    return F.when(has(RATE_WORDS), "rate_limit").when(low.contains("image") & has(IMAGE_WORDS), "image_processing").when(has(TIME_WORDS), "timeout").otherwise(stage)


def paragraphs(text: Column) -> Column:
    """Paragraphs (between blank lines) each on one line, blank ones dropped."""
    one = F.transform(F.split(text, r"\n{2,}"), lambda p: F.trim(F.regexp_replace(F.replace(p, F.lit("\n"), F.lit(" ")), " {2,}", " ")))
    return F.array_join(F.filter(one, lambda p: p != ""), "\n\n")


def chunks(text: Column, most: int) -> Column:
    """Whole paragraphs packed greedily into chunks; array. A paragraph longer than `most` stays whole.

    The running length counts two more for each paragraph appended, but not for one that opens a chunk after a full one.
    """
    pieces = F.filter(F.transform(F.split(text, "\n\n"), lambda p: F.regexp_replace(p, r"(?U)^\s+|\s+$", "")), lambda p: p != "")
    start = F.struct(F.expr("cast(array() as array<string>)").alias("done"), F.lit(None).cast("string").alias("open"), F.lit(0).alias("held"))

    def step(acc: Column, p: Column) -> Column:
        full = acc["open"].isNotNull() & (acc["held"] + F.char_length(p) > most)
        return F.struct(
            F.when(full, F.array_append(acc["done"], acc["open"])).otherwise(acc["done"]).alias("done"),
            F.when(full | acc["open"].isNull(), p).otherwise(F.concat(acc["open"], F.lit("\n\n"), p)).alias("open"),
            F.when(full, F.char_length(p)).otherwise(acc["held"] + F.char_length(p) + 2).alias("held"),
        )

    return F.aggregate(pieces, start, step, lambda acc: F.when(acc["open"].isNull(), acc["done"]).otherwise(F.array_append(acc["done"], acc["open"])))


def max_tokens(chars: Column) -> Column:
    """Output tokens granted for a chunk: an eighth of its characters, from 4096 to 16384."""
    return F.greatest(F.lit(4096), F.least(F.floor(F.floor(chars * 0.5) / 4), F.lit(16384)))


def by_rank(tier: Column, ranks: Sequence[tuple[str, int]], default: int = 0) -> Column:
    """The rank of a tier in a fixed list."""
    out = F.lit(default)
    for name, rank in ranks:
        out = F.when(tier == name, rank).otherwise(out)
    return out
