"""Text functions as column expressions."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, DataType, IntegralType, MapType, StringType, StructType

TOKEN = r"[\p{L}\p{N}]+"

#: Words that say nothing about a claim's subject, frequent words first, then those of all papers.
STOP_WORDS = (
    "that", "this", "with", "from", "have", "will", "been", "were", "being",
    "their", "there", "they", "them", "then", "than", "what", "when", "where",
    "which", "while", "would", "could", "should", "about", "after", "before",
    "between", "through", "under", "over", "into", "also", "each", "every",
    "both", "such", "some", "more", "most", "only", "very", "much", "many",
    "does", "done", "make", "made", "take", "taken", "give", "given", "come",
    "came", "goes", "went", "said", "tell", "told", "find", "found", "know",
    "knew", "known", "show", "shown", "showed", "like", "used", "using",
    "case", "well", "just", "even", "still", "back",
    "model", "result", "results", "paper", "study", "approach", "method",
    "analysis", "problem", "based", "prove", "proof", "theorem", "shows",
    "implies", "condition", "conditions", "exist", "exists", "existence",
    "optimal", "increase", "increases", "decrease", "decreases",
    "expected", "probability", "function", "number", "value", "values",
    "general", "sufficient", "necessary", "unique", "total",
)
#: Signs of work by others, and of a quote cut off from what it points to; both whatever the case.
OTHERS_WORK = r"(?i)\b(?:analy[sz]ed|shown|proved|proposed|introduced)\s+(?:further\s+)?by\b|\bwho\s+(?:have\s+)?(?:shown|proved)\b"
CUT_OFF = r"(?i)^\s*(?:this|that|these|those)\s+(?:method|approach|auction|result|algorithm)"


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))


def keywords(text: Column) -> Column:
    """Distinct ASCII words of four letters or more, without stop words, and runs of two or more Han characters."""
    plain = F.regexp_extract_all(F.lower(text), F.lit("[a-z]{4,}"), F.lit(0))
    han = F.regexp_extract_all(text, F.lit("[\\x{4e00}-\\x{9fff}]{2,}"), F.lit(0))
    return F.array_distinct(F.concat(F.array_except(plain, F.array(*map(F.lit, STOP_WORDS))), han))


def canonical_work(uri: Column) -> Column:
    """The DOI of an address, however it is written, as doi:...; null for others."""
    plain = F.lower(F.try_url_decode(F.replace(F.trim(uri), F.lit("+"), F.lit("%2B"))))
    bare = F.trim(F.regexp_replace(plain, r"^(https?://(dx\.)?doi\.org/|doi:\s*)", ""))
    return F.when(bare.rlike(r"^10\.[0-9]{4,9}/\S+$"), F.concat(F.lit("doi:"), bare))


def field_id(discipline: Column) -> Column:
    """F- and the first four letters, spaces out and & as AND; different names can share one."""
    return F.concat(F.lit("F-"), F.substring(F.upper(F.replace(F.replace(discipline, F.lit(" "), F.lit("")), F.lit("&"), F.lit("AND"))), 1, 4))


def sentence_context(quote: Column, text: Column) -> Column:
    """From the start of the sentence in which the first occurrence of ``quote`` begins to the quote's end."""
    before = F.substring(text, F.lit(1), F.instr(text, quote) - 1)
    return F.concat(F.regexp_extract(before, r"(?s)^(?:.*(?:\. |\n))?(.*)$", 1), quote)


def attribution_reasons(quote: Column, text: Column) -> Column:
    missing = F.instr(text, quote) == 0
    return F.when(missing, F.array(F.lit("quote_missing"))).otherwise(
        F.array_compact(F.array(F.when(sentence_context(quote, text).rlike(OTHERS_WORK), F.lit("prior_work")), F.when(quote.rlike(CUT_OFF), F.lit("cropped_antecedent"))))
    )


def front_matter(text: Column) -> Column:
    """The scalar fields between the first two lines of three dashes, as a map; later names win."""
    block = F.regexp_extract(text, r"(?s)^---\n(.*?)\n---", 1)
    names = F.regexp_extract_all(block, F.lit(r"(?m)^([\w-]+):[ \t]*(.*)$"), F.lit(1))
    values = F.regexp_extract_all(block, F.lit(r"(?m)^([\w-]+):[ \t]*(.*)$"), F.lit(2))
    pairs = F.arrays_zip(names.alias("k"), values.alias("v"))
    last = F.filter(F.transform(pairs, lambda p, i: F.struct(p["k"].alias("k"), p["v"].alias("v"), i.alias("i"))), lambda p: F.array_position(F.reverse(names), p["k"]) == F.size(names) - p["i"])
    return F.map_from_entries(F.transform(last, lambda p: F.struct(p["k"], p["v"])))


def section(text: Column, heading: str) -> Column:
    return F.trim(F.regexp_extract(text, rf"(?s)(?:^|\n)## {heading}[ \t]*\n(.*?)(?:\n## |$)", 1))


RELATION = "struct<to:string,type:string,confidence:double,epistemic_status:string,note:string>"


def relations(text: Column) -> Column:
    """The records of the Relations section of a note, by a fold over its lines: "- to:" opens a record and ends the one before, and the
    lines after it fill its fields; other lines count for nothing. A bad confidence is 0.5, one that isn't there null;
    a field before any "- to:" makes a record without one. The last of repeated fields wins."""
    block = F.regexp_extract(text, r"(?s)##\s+Relations\s*\n(.*?)(?=\n##\s|\z)", 1)
    lines = F.transform(F.split(F.trim(block), r"\r?\n"), lambda x: F.regexp_replace(x, r"^\s+|\s+$", ""))
    none, no_records = F.lit(None).cast(RELATION), F.array().cast(f"array<{RELATION}>")
    fields = ("to", "type", "confidence", "epistemic_status", "note")

    def on(state: Column, line: Column) -> Column:
        now, value = state["now"], F.regexp_replace(F.regexp_extract(line, r"(?s)^[^:]*:(.*)$", 1), r"^\s+|\s+$", "")
        number = F.when(value.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), value.try_cast("double"))
        told = {"type": value, "confidence": F.coalesce(number, F.lit(0.5)), "epistemic_status": value, "note": F.regexp_replace(value, '^"+|"+$', "")}
        filled = lambda name: F.struct(*[(told[f] if f == name else now[f]).alias(f) for f in fields])
        opened = F.struct(value.alias("to"), *[F.lit(None).cast("double" if f == "confidence" else "string").alias(f) for f in fields[1:]])
        done = F.when(line.startswith("- to:") & now.isNotNull(), F.concat(state["done"], F.array(now))).otherwise(state["done"])
        then = F.when(line.startswith("- to:"), opened)
        for name in fields[1:]:
            then = then.when(line.startswith(f"{name}:"), filled(name))
        return F.struct(done.alias("done"), then.otherwise(now).cast(RELATION).alias("now"))

    end = lambda state: F.when(state["now"].isNull(), state["done"]).otherwise(F.concat(state["done"], F.array(state["now"])))
    return F.aggregate(lines, F.struct(no_records.alias("done"), none.alias("now")), on, end)


#: The four ways in which a related card may be written, in the order in which they are tried.
RELATED = (
    r"^concept_id:\s*(K-\d{4}),?\s*relation_type:\s*(\w+)(?:\s*[—\-（(]\s*(.+?)[\)）]?)?$",
    r"^(K-\d{4})\s*[（(]([^）)]+)[）)]\s*[:：]\s*(.+)",
    r"^(K-\d{4})\s*[:：]\s*(.+)",
    r"^(K-\d{4})\s+([^:：]+)[:：]\s*(.+)",
)


def related(line: Column) -> Column:
    """The card that a line names, as to, type and note; null for other lines."""
    plain = F.regexp_replace(F.regexp_replace(F.regexp_replace(line, r"(?U)^\s+|\s+$", ""), "^[- ]+", ""), r"(?U)^\s+|\s+$", "")
    part = lambda i, g: F.regexp_replace(F.regexp_extract(plain, f"(?U){RELATED[i]}", g), r"(?U)^\s+|\s+$", "")
    is_ = lambda i: plain.rlike(f"(?U){RELATED[i]}")
    record = lambda i, kind, note: F.struct(part(i, 1).alias("to"), kind.alias("type"), note.alias("note"))
    other = F.lit("related")
    return F.when(is_(0), record(0, part(0, 2), part(0, 3))).when(is_(1), record(1, other, part(1, 3))).when(is_(2), record(2, other, part(2, 2))).when(is_(3), record(3, other, F.concat(part(3, 2), F.lit(" — "), part(3, 3))))


def migrated(text: Column) -> Column:
    """A note of the first schema in the second: its Related Concepts become typed relations, and its header tells the schema. Null
    where nothing is to be done: for notes without a header, and those that name a schema already."""
    parts = F.split(text, "---", 3)
    head, body = F.get(parts, 1), F.get(parts, 2)
    cut = r"(?s)^(.*?)##\s+Related\s+Concepts\s*\n(.*?)(?=\n##\s|\z)(.*)$"
    found = F.filter(F.transform(F.split(F.regexp_extract(body, cut, 2), r"\r?\n"), related), lambda r: r.isNotNull())
    note = lambda r: F.when(r["note"] != "", F.concat(F.lit('  note: "'), r["note"], F.lit('"\n'))).otherwise("")
    shown = F.transform(found, lambda r: F.concat(F.lit("- to: "), r["to"], F.lit("\n  type: "), r["type"], F.lit("\n  confidence: 0.8\n  epistemic_status: established\n"), note(r), F.lit("\n")))
    section_ = F.concat(F.lit("## Relations\n\n"), F.when(F.size(found) > 0, F.array_join(shown, "")).otherwise("(なし)\n"))
    new = F.when(body.rlike(cut), F.concat(F.regexp_extract(body, cut, 1), section_, F.regexp_extract(body, cut, 3))).otherwise(body)
    header = F.concat(F.regexp_replace(head, r"(?U)\s+$", ""), F.lit("\nschema_version: 2\n"))
    fits = text.startswith("---") & (F.size(parts) == 3) & ~text.contains("schema_version:")
    return F.when(fits, F.concat(F.lit("---"), F.when(head.contains("schema_version"), head).otherwise(header), F.lit("---"), new))


def facet_view(status: Column, path: Column, definition: Column, deltas: Column, states: Column, context: str) -> Column:
    """A card as it reads in a context: definition and epistemic_status. ``deltas`` and ``states`` are maps by context; a card that isn't approved, or
    lies in an inbox, is blank and unverified. A context without its own definition keeps the card's."""
    blank = ~F.coalesce(status.isin("approved", "accepted"), F.lit(False)) | path.contains("_inbox")
    told = F.coalesce(F.try_element_at(deltas, F.lit(context)), definition)
    state = F.coalesce(F.try_element_at(states, F.lit(context)), F.lit("established"))
    return F.struct(F.when(blank, "").otherwise(told).alias("definition"), F.when(blank, "unverified").otherwise(state).alias("epistemic_status"))


def from_positions(index: Column) -> Column:
    """The text of a map from words to their positions: words in order, one space between them. Positions without a word are
    passed over; of several words at one position the last in the map stands. A null map gives null, an empty one an empty text."""
    pairs = F.flatten(F.transform(F.map_entries(index), lambda e, i: F.transform(e["value"], lambda p: F.struct(p.alias("at"), (-i).alias("i"), e["key"].alias("word")))))
    # Named by a lambda, so that the sorted pairs are made once and not once for each of them.
    first = lambda order: F.filter(order, lambda p, i: (i == 0) | (F.get(order, i - 1)["at"] != p["at"]))
    kept = F.get(F.transform(F.array(F.array_sort(pairs)), first), 0)
    return F.array_join(F.transform(kept, lambda p: p["word"]), " ")


def json_text(value: Column, kind: DataType) -> Column:
    """``value`` as Python's ``json.dumps(..., ensure_ascii=False, sort_keys=True)`` writes it, of strings, whole numbers, truth values, nulls, and
    arrays, structs and maps (with string keys) of such; other types raise."""
    null = F.lit("null")
    if isinstance(kind, StringType):
        plain = F.replace(F.replace(value, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
        short = {"\n": "n", "\r": "r", "\t": "t", "\b": "b", "\f": "f"}
        told = plain
        for code in range(32):
            escape = f"\\{short[chr(code)]}" if chr(code) in short else f"\\u{code:04x}"
            told = F.replace(told, F.lit(chr(code)), F.lit(escape))
        shown = F.concat(F.lit('"'), F.when(plain.rlike(r"[\x00-\x1f]"), told).otherwise(plain), F.lit('"'))
    elif isinstance(kind, (IntegralType, BooleanType)):
        shown = value.cast("string")
    elif isinstance(kind, ArrayType):
        shown = F.concat(F.lit("["), F.array_join(F.transform(value, lambda x: json_text(x, kind.elementType)), ", "), F.lit("]"))
    elif isinstance(kind, StructType):
        fields = sorted(kind.fields, key=lambda f: f.name)
        parts = [F.concat(F.lit(f"{json.dumps(f.name, ensure_ascii=False)}: "), json_text(value[f.name], f.dataType)) for f in fields]
        shown = F.concat(F.lit("{"), F.concat_ws(", ", *parts), F.lit("}"))
    elif isinstance(kind, MapType) and isinstance(kind.keyType, StringType):
        pair = lambda e: F.concat(json_text(e["key"], kind.keyType), F.lit(": "), json_text(e["value"], kind.valueType))
        keys = F.array_sort(F.map_keys(value))
        shown = F.concat(F.lit("{"), F.array_join(F.transform(keys, lambda k: pair(F.struct(k.alias("key"), value[k].alias("value")))), ", "), F.lit("}"))
    else:
        raise TypeError(f"no canonical form of {kind.simpleString()}")
    return F.coalesce(F.when(value.isNotNull(), shown), null)


def json_digest(df: DataFrame, *columns: str) -> Column:
    """SHA-256 of the columns of ``df`` as one JSON list."""
    parts = [json_text(F.col(c), df.schema[c].dataType) for c in columns]
    return F.sha2(F.concat(F.lit("["), F.concat_ws(", ", *parts), F.lit("]")), 256)


def salvaged(raw: Column) -> Column:
    """The JSON in a model's answer, as a VARIANT: what a fenced block holds, or the whole, if it can be parsed; else what stands from the
    first brace to the last. Null where neither can."""
    fenced = F.nullif(F.regexp_extract(raw, r"(?s)```(?:json)?\s*(.*?)\s*```", 1), F.lit(""))
    braced = F.nullif(F.regexp_extract(F.coalesce(fenced, raw), r"(?s)(\{.*\})", 1), F.lit(""))
    return F.coalesce(F.try_parse_json(F.coalesce(fenced, raw)), F.try_parse_json(braced))


def salvage_json(raw: Column) -> Column:
    """The JSON in a model's answer, as text: a fenced block, or else from the first brace to the last."""
    fenced = F.regexp_extract(raw, r"(?s)```(?:json)?\s*(\{.*?\})\s*```", 1)
    return F.when(fenced != "", fenced).otherwise(F.nullif(F.regexp_extract(raw, r"(?s)(\{.*\})", 1), F.lit("")))


def grade(exists: Column, abstract: Column, relevance: Column, citations: Column, open_access: Column) -> Column:
    """A verification grade: 3 for existing, 1 for an abstract, 2 or 1 for relevance, 1 for over ten citations, 0.5 for open access."""
    score = F.lit(3.0) + F.when(abstract, 1.0).otherwise(0.0) + F.when(relevance == "likely", 2.0).when(relevance == "possible", 1.0).otherwise(0.0) + F.when(citations > 10, 1.0).otherwise(0.0) + F.when(open_access, 0.5).otherwise(0.0)
    return F.when(~exists, "REJECTED").when(score >= 6, "A").when(score >= 4, "B").when(score >= 3, "C").otherwise("D")


def shorten(text: Column, most: int = 45) -> Column:
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most - 3), F.lit("..."))).otherwise(text)
