"""Expressions over structured summaries: model replies, JSON columns, Markdown."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schemas import SUMMARY, SUMMARY_ARRAYS
from .basic import col, let, non_empty, strip
from .text import sentences

# Headings, labels and defaults of a Markdown summary.
MARKDOWN_TITLE = "# Podcast Summary"
MARKDOWN_HEADINGS = {
    "host_and_guest": "## Host and Guest",
    "comprehensive_summary": "## Comprehensive Summary",
    "key_topics": "## Key Topics and Themes",
    "actionable_quotes": "## Actionable Quotes",
    "investment_theses": "## Investment Theses",
    "noteworthy_observations": "## Noteworthy Observations",
    "company_mentions": "## Company Mentions",
}
MARKDOWN_LABELS = {
    "quote": "### Quote ", "context_of_quote": "*Context: ", "thesis": "### Thesis ", "reasoning": "**Reasoning:** ",
    "risks": "**Risks/Caveats:** ", "industry": "**Industry:** ", "context": "**Context:** ", "details": "**Details:** ",
}
MISSING_TEXT, MISSING_TOPIC, MISSING_SPEAKER, MISSING_COMPANY = "N/A", "Unknown Topic", "Unknown", "Unknown Company"


def unfence(reply: str | Column) -> Column:
    """Trim a model reply and drop the first and last line of a fenced block of more than two lines."""

    def inner(text: Column) -> Column:
        lines = F.split(text, "\n")
        body = let(lines, lambda a: F.when(F.size(a) > 2, F.array_join(F.slice(a, F.lit(2), F.greatest(F.size(a) - 2, F.lit(0))), "\n")))
        return F.when(F.startswith(text, F.lit("```")), F.coalesce(body, text)).otherwise(text)

    return let(strip(reply), inner)


def _whole_json(text: Column) -> Column:
    """The text as one JSON value; NULL if it is none, has a key twice, or if anything stands behind the value.

    The parser stops behind the first value, so the text is put into an object whose last member is only there if the value took all of it.
    """
    framed = F.concat(F.lit('{"value":'), text, F.lit(',"whole":true}'))
    return let(F.try_parse_json(framed), lambda v: F.when(F.try_variant_get(v, "$.whole", "boolean"), F.try_variant_get(v, "$.value", "variant")))


def _array_of(name: str, elements: Column) -> Column:
    """Elements, each a variant, as the summary field ``name`` has them, one by one.

    A value of another type than text is its JSON text. An element that should have fields and is none of an object's keeps its text in the
    first field, so that nothing of the array is lost; a null stays null.
    """
    type_ = SUMMARY_ARRAYS[name]
    text = lambda v, path="$": F.try_variant_get(v, path, "string")
    if "STRUCT" not in type_:
        return F.transform(elements, lambda v: text(v))
    fields = [f.split(":")[0].strip() for f in type_.removeprefix("ARRAY<STRUCT<").rstrip(">").split(",")]

    def element(v: Column) -> Column:
        def kept(named: Column) -> Column:
            bare = F.struct(text(v).alias(fields[0]), *[F.lit(None).cast("string").alias(f) for f in fields[1:]])
            # The cast to a map holds for objects only.
            is_object = F.try_variant_get(v, "$", "map<string, variant>").isNotNull()
            known = F.exists(F.array(*[named[f].isNotNull() for f in fields]), lambda p: p)
            return F.when(known | is_object, named).when(text(v).isNotNull(), bare)

        return let(F.struct(*[text(v, f"$.{f}").alias(f) for f in fields]), kept)

    return F.transform(elements, element).cast(type_)


def decode(reply: str | Column) -> Column:
    """Model reply to summary struct; NULL when it is not one whole JSON object with any of the fields, as with text behind the object."""

    def known(v: Column) -> Column:
        texts = [F.try_variant_get(v, f"$.{name}", "string").alias(name) for name in ("host_and_guest", "comprehensive_summary")]
        arrays = [_array_of(name, F.try_variant_get(v, f"$.{name}", "array<variant>")).alias(name) for name in SUMMARY_ARRAYS]
        return F.struct(*texts, *arrays).cast(SUMMARY)

    def filled(summary: Column) -> Column:
        present = [summary[name].isNotNull() for name in ("host_and_guest", "comprehensive_summary", *SUMMARY_ARRAYS)]
        return F.when(F.exists(F.array(*present), lambda p: p), summary)

    return let(let(_whole_json(unfence(reply)), known), filled)


def decode_array(name: str, text: str | Column) -> Column:
    """Stored JSON array of the summary field ``name``, element by element; NULL, empty or unreadable text is an empty array."""
    elements = F.try_variant_get(_whole_json(non_empty(text)), "$", "array<variant>")
    return F.coalesce(_array_of(name, elements), F.array().cast(SUMMARY_ARRAYS[name]))


def encode_array(array: str | Column) -> Column:
    """JSON text of an array; ``[]`` when it is missing."""
    return F.coalesce(F.to_json(col(array), {"ignoreNullFields": "false"}), F.lit("[]"))


def stored(df: DataFrame) -> DataFrame:
    """Rows of the summaries table to ``(episode_id, …, summary)`` with real arrays."""
    fields = [F.col("host_and_guest"), F.col("comprehensive_summary")]
    fields += [decode_array(name, name).alias(name) for name in SUMMARY_ARRAYS]
    return df.select("id", "episode_id", "model_used", "created_at", F.struct(*fields).alias("summary"))


def storable(df: DataFrame, summary: str = "summary") -> DataFrame:
    """Replace the struct column by the text columns of the summaries table."""
    s = F.col(summary)
    rest = [c for c in df.columns if c != summary]
    return df.select(
        *rest, s["host_and_guest"].alias("host_and_guest"), s["comprehensive_summary"].alias("comprehensive_summary"),
        *[encode_array(s[name]).alias(name) for name in SUMMARY_ARRAYS],
    )


def document(summary: str | Column) -> Column:
    """Indented JSON document of a summary."""
    return F.to_json(col(summary), {"ignoreNullFields": "false", "pretty": "true"})


def markdown(summary: str | Column) -> Column:
    """Headed sections with one entry per block; blocks are separated by an empty line."""
    s = col(summary)
    labels = {name: F.lit(label) for name, label in MARKDOWN_LABELS.items()}

    def text(c: Column, default: str = "") -> Column:
        return F.coalesce(c, F.lit(default))

    def block(*pieces: str | Column) -> Column:
        return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in pieces], F.lit("\n"))

    def labelled(label: str, c: Column) -> Column:
        """A block that is left out with its label when the text is empty."""
        return F.when(F.length(c) > 0, F.concat(F.lit("\n"), block(labels[label], c))).otherwise(F.lit(""))

    def number(i: Column) -> Column:
        return (i + 1).cast("string")

    entries = {
        "key_topics": lambda t: F.concat(block("### ", text(t["topic"], MISSING_TOPIC)), F.lit("\n"), block(text(t["description"]))),
        "actionable_quotes": lambda q, i: F.concat(
            block(labels["quote"], number(i)), F.lit("\n"), block('> "', text(q["quote"]), '"'), F.lit("\n"),
            block("**— ", text(q["speaker"], MISSING_SPEAKER), "**"), F.lit("\n"),
            block(labels["context_of_quote"], text(q["context"]), "*")),
        "investment_theses": lambda t, i: F.concat(
            block(labels["thesis"], number(i), ": ", text(t["thesis"], MISSING_TEXT)), F.lit("\n"),
            block(labels["reasoning"], text(t["reasoning"])), labelled("risks", t["risks"])),
        "noteworthy_observations": lambda o: block("- ", text(o)),
        "company_mentions": lambda c: F.concat(
            block("### ", text(c["name"], MISSING_COMPANY)), F.lit("\n"), block(labels["industry"], text(c["industry"], MISSING_TEXT)),
            F.lit("\n"), block(labels["context"], text(c["context"])), labelled("details", c["details"])),
    }
    parts = [block(MARKDOWN_TITLE)]
    for field, heading in MARKDOWN_HEADINGS.items():
        parts.append(block(heading))
        if field in entries:
            body = F.array_join(F.transform(s[field], entries[field]), "\n")
            parts.append(F.when(F.size(s[field]) > 0, body))
        else:
            parts.append(block(text(s[field], MISSING_TEXT)))
    # concat_ws leaves out the sections without entries.
    return F.when(s.isNotNull(), F.concat_ws("\n", *parts))


def frequent_words(text: str | Column, n: int, shortest: int = 4) -> Column:
    """The ``n`` most frequent words as ``(less, word)``: the count negated, so that struct order is by falling count, then word.

    The counts are the lengths of the runs in the sorted array of words: no shuffle, and sorting is the dearest step.
    """
    words = F.filter(F.split(F.lower(col(text)), r"[^\p{L}]+"), lambda w: F.length(w) >= shortest)

    def counted(ordered: Column) -> Column:
        begins = F.filter(
            F.transform(ordered, lambda w, i: F.when((i == 0) | (w != F.get(ordered, i - 1)), i)), lambda i: i.isNotNull()
        )

        def lengths(runs: Column) -> Column:
            return F.transform(runs, lambda at, j: F.struct(
                (at - F.coalesce(F.get(runs, j + 1), F.size(ordered))).alias("less"), F.get(ordered, at).alias("word")))

        return let(begins, lengths)

    return F.slice(F.sort_array(let(F.sort_array(words), counted)), 1, n)


def rule_summary(
    text: str | Column,
    n_overview: int = 3,
    n_topics: int = 5,
    n_quotes: int = 3,
    n_observations: int = 3,
) -> Column:
    """Fill the summary struct by rules: the stand-in for a hosted model, with the same output.

    Overview: first sentences. Topics: most frequent words of at least four letters. Quotes: longest sentences, the earlier first.
    Observations: first sentences with a digit. Companies are left empty; ``operators.mentions`` finds them with a table of names. Blank
    text has no summary. Every text is worked out on its own, so there is no shuffle.
    """
    topics = F.transform(frequent_words(text, n_topics), lambda c: F.struct(
        c["word"].alias("topic"),
        F.concat(F.lit("Mentioned "), (-c["less"]).cast("string"), F.lit(" times")).alias("description")))

    def filled(said: Column) -> Column:
        by_length = F.sort_array(F.transform(said, lambda s, i: F.struct((-F.length(s)).alias("less"), i.alias("at"))))
        quotes = F.transform(F.slice(by_length, 1, n_quotes), lambda q: F.struct(
            F.get(said, q["at"]).alias("quote"), F.lit("Unknown").alias("speaker"),
            F.concat(F.lit("Sentence "), (q["at"] + 1).cast("string")).alias("context")))
        observations = F.slice(F.filter(said, lambda s: F.rlike(s, F.lit("[0-9]"))), 1, n_observations)
        fields = {
            "key_topics": topics, "actionable_quotes": quotes, "investment_theses": F.array(),
            "noteworthy_observations": observations, "company_mentions": F.array(),
        }
        return F.when(F.size(said) > 0, F.struct(
            F.lit("Unknown").alias("host_and_guest"),
            F.array_join(F.slice(said, 1, n_overview), ". ").alias("comprehensive_summary"),
            *[value.cast(SUMMARY_ARRAYS[name]).alias(name) for name, value in fields.items()],
        ))

    return let(F.filter(F.transform(sentences(text), strip), lambda s: F.length(s) > 0), filled)
