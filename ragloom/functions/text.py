"""Scalar text functions (Column -> Column): normalisers, n-grams, URLs, identifiers, hashes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ColumnOrName = Column | str


def col(x: ColumnOrName) -> Column:
    return F.col(x) if isinstance(x, str) else x


def let(value: Column, body) -> Column:
    """body(value) with `value` evaluated once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def empty_to_null(x: ColumnOrName) -> Column:
    """Blank text and null are one: null."""
    trimmed = F.trim(col(x))
    return F.when(trimmed == "", None).otherwise(trimmed)


# --- normalisers (10.14-10.16, 9.10) ---------------------------------------------------------------------------------------------------
def normalise_tight(x: ColumnOrName) -> Column:
    """Lower case without any white space."""
    return F.regexp_replace(F.lower(F.coalesce(col(x), F.lit(""))), r"(?U)\s+", "")


def normalise_query(x: ColumnOrName) -> Column:
    """Lower case, only 0-9, a-z and CJK ideographs."""
    return F.regexp_replace(F.lower(F.coalesce(col(x), F.lit(""))), r"[^0-9a-z\x{4e00}-\x{9fff}]+", "")


def normalise_words(x: ColumnOrName) -> Column:
    """Lower case, only word characters of any script and CJK ideographs."""
    return F.regexp_replace(F.lower(F.coalesce(col(x), F.lit(""))), r"(?U)[^\w\x{4e00}-\x{9fff}]+", "")


def collapse_spaces(x: ColumnOrName) -> Column:
    return F.trim(F.regexp_replace(F.coalesce(col(x), F.lit("")), r"(?U)\s+", " "))


def subject_id(name: ColumnOrName) -> Column:
    """Stable id of a subject name: white space collapsed, lower case, SHA-1, 16 digits."""
    return F.concat(F.lit("subject_"), F.left(F.sha1(F.lower(collapse_spaces(name))), F.lit(16)))


def slug(x: ColumnOrName) -> Column:
    """Lower case; every character that is no letter or digit becomes a dash."""
    return F.regexp_replace(F.lower(F.coalesce(col(x), F.lit(""))), r"(?U)[^\p{L}\p{N}]", "-")


def escape_literal(x: ColumnOrName) -> Column:
    """A value for a quoted filter literal: backslash and quote escaped, line breaks and tabs as spaces (3.6)."""
    out = F.regexp_replace(F.coalesce(col(x), F.lit("")), r"[\r\n\t]", " ")
    return F.replace(F.replace(out, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))


# --- n-grams and similarity (10.17, 10.18) -----------------------------------------------------------------------------------------------
def char_ngrams(x: ColumnOrName, size: int) -> Column:
    """Distinct character n-grams in order of first occurrence; a shorter text is its own only gram, an empty one has none."""
    chars = F.filter(F.split(F.coalesce(col(x), F.lit("")), ""), lambda c: c != "")

    def of(c: Column) -> Column:
        runs = F.transform(F.sequence(F.lit(0), F.greatest(F.size(c) - size, F.lit(0))), lambda i: F.array_join(F.slice(c, i + 1, size), ""))
        return F.when(F.size(c) == 0, F.array().cast("array<string>")).otherwise(F.array_distinct(runs))

    return F.element_at(F.transform(F.array(chars), of), 1)


def jaccard(a: ColumnOrName, b: ColumnOrName) -> Column:
    """|a & b| / |a | b| of two distinct arrays; 0 for an empty union."""
    shared = F.size(F.array_intersect(col(a), col(b)))
    union = F.size(F.array_union(col(a), col(b)))
    return F.when(union > 0, shared / union).otherwise(0.0)


# --- URLs (10.12, 10.13) -----------------------------------------------------------------------------------------------------------------
_URL = r"^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)([^?#]*)(\?[^#]*)?(#.*)?$"


def canonical_url(url: ColumnOrName) -> Column:
    """Lower-case scheme and host part, no trailing slashes in the path ('/' if nothing is left), query kept, fragment dropped.

    A text without scheme or host only loses its trailing slashes. Blank is null.
    """
    u = F.trim(col(url))
    path = F.regexp_replace(F.regexp_extract(u, _URL, 3), "/+$", "")
    full = F.concat(F.lower(F.regexp_extract(u, _URL, 1)), F.lit("://"), F.lower(F.regexp_extract(u, _URL, 2)), F.when(path == "", "/").otherwise(path), F.regexp_extract(u, _URL, 4))
    return F.when(u == "", None).when(F.regexp_extract(u, _URL, 2) != "", full).otherwise(F.regexp_replace(u, "/+$", ""))


def url_host(url: ColumnOrName) -> Column:
    return F.lower(F.regexp_extract(F.trim(col(url)), _URL, 2))


def candidate_identity(source_type: ColumnOrName, chunk_id: ColumnOrName, url: ColumnOrName) -> Column:
    """local:<chunk id> or web:<canonical URL>."""
    return F.when(col(source_type) == "web", F.concat(F.lit("web:"), canonical_url(url))).otherwise(F.concat(F.lit("local:"), col(chunk_id).cast("string")))


# --- identifiers (9.6, 9.8, 10.1-10.11) --------------------------------------------------------------------------------------------------
_EDGE_L, _EDGE_R = r"(?<![A-Za-z0-9])", r"(?![A-Za-z0-9])"
#: Fixed values, all matched without regard to case: what counts as a technical identifier, an alarm, an SOP, a part number (after one of
#: its labels) and a model code.
TECHNICAL_PATTERN = r"(?<![A-Za-z0-9])([A-Za-z]{1,12})[\s_-]*(\d[A-Za-z0-9]*(?:[-_]+[A-Za-z0-9]+)*)(?![A-Za-z0-9])"
ALARM_PATTERN = r"(?<![A-Za-z0-9])E[\s_-]*(\d{3,4})(?![A-Za-z0-9])"
SOP_PATTERN = r"(?<![A-Za-z0-9])SOP[\s_-]*([A-Za-z]*\d+(?:[-_][A-Za-z0-9]+)*)"
PART_LABELS = r"(?:零件(?:编号|号)?|备件(?:编号|号)?|配件(?:编号|号)?|料号|物料编码|P\s*/\s*N|PART\s*(?:NUMBER|NO\.?))"
PART_VALUES = r"([A-Za-z0-9]+(?:[-_][A-Za-z0-9]+)+|[A-Za-z]+\s+\d+[A-Za-z0-9]*|[A-Za-z]+\d+[A-Za-z0-9]*|\d+[A-Za-z]+[A-Za-z0-9]*)"
MODEL_CODE_PATTERN = r"(?<![A-Za-z0-9])([A-Za-z]{2,})[\s\-_]*([0-9]{2,}[A-Za-z0-9]*)(?![A-Za-z0-9])"


def possessive(pattern: str) -> str:
    """The pattern for Java's matcher, which goes one level deeper for each turn of a repeated group unless the group keeps what it took.

    In the patterns above every turn begins with a separator, so giving back a turn never helps and the matches are the same.
    """
    return "(?i)" + pattern.replace("+)*", "++)*+").replace("+)+", "++)++")


VARIANT, ALARM, SOP, PART, MODEL_CODE = (possessive(x) for x in (TECHNICAL_PATTERN, ALARM_PATTERN, SOP_PATTERN, PART_LABELS + r"\s*[:：#]?\s*" + PART_VALUES, MODEL_CODE_PATTERN))


def model_names(text: Column) -> Column:
    """array of (prefix, number): every run of letters and digits with a digit in it, and the words before it.

    The text is cut into stretches of letters, digits and separators, these into runs. The words since the last run with a digit are the
    prefix, with the run's own first letters unless it has just one after other words (PixLab B5). A run that begins with a digit and
    has no word before it names nothing. Each step is one pass, so words and names may be of any number and length.
    """

    def names(runs: Column) -> Column:
        def name(coded: Column, i: Column, k: Column) -> Column:
            before = F.when(k > 0, F.get(coded, k - 1)).otherwise(-1)
            words, run = F.array_join(F.slice(runs, before + 2, i - before - 1), " "), F.get(runs, i)
            head = F.regexp_extract(run, "^[A-Za-z]*", 0)
            own = (words == "") | (F.length(head) > 1)
            prefix = F.when(own, F.trim(F.concat_ws(" ", words, head))).otherwise(words)
            return F.when(prefix != "", F.struct(prefix.alias("prefix"), F.when(own, F.substr(run, F.length(head) + 1)).otherwise(run).alias("number")))

        coded = F.filter(F.sequence(F.lit(0), F.size(runs) - 1), lambda i: F.get(runs, i).rlike("[0-9]"))
        # bound once by a transform over an array of itself
        found = F.element_at(F.transform(F.array(coded), lambda c: F.transform(c, lambda i, k: name(c, i, k))), 1)
        return F.when(F.size(runs) > 0, F.array_compact(found))

    stretches = F.split(text, r"[^A-Za-z0-9\s_-]+")
    runs = F.transform(stretches, lambda s: F.filter(F.split(s, r"[\s_-]+"), lambda r: r != ""))
    return F.flatten(F.array_compact(F.transform(runs, names)))


def spellings(prefix: Column, number: Column) -> Column:
    return F.array(F.concat(prefix, number), F.concat(prefix, F.lit("-"), number), F.concat(prefix, F.lit(" "), number))


def identifier_variants(text: ColumnOrName) -> Column:
    """HAK-180 -> HAK180, HAK-180, HAK 180 for every identifier of the text; ordered, distinct, joined by spaces."""
    t = F.upper(F.coalesce(col(text), F.lit("")))
    numbers = F.transform(F.regexp_extract_all(t, F.lit(VARIANT), F.lit(2)), lambda n: F.regexp_replace(n, "[_-]", ""))
    pairs = F.zip_with(F.regexp_extract_all(t, F.lit(VARIANT), F.lit(1)), numbers, spellings)
    return F.array_join(F.array_distinct(F.flatten(pairs)), " ")


def model_code_aliases(*texts: ColumnOrName) -> Column:
    """Spellings of codes with two or more letters and two or more digits, first spelling of each (case aside)."""
    t = F.concat_ws(" ", *(col(x) for x in texts))
    pairs = F.zip_with(*(F.regexp_extract_all(F.upper(t), F.lit(MODEL_CODE), F.lit(n)) for n in (1, 2)), spellings)
    return F.array_distinct(F.flatten(pairs))


def alias_type(alias: ColumnOrName, standard: ColumnOrName, file_title: ColumnOrName, llm_name: ColumnOrName) -> Column:
    a = col(alias)
    return F.when(a == col(standard), "standard").when(a == col(file_title), "file_title").when(a == col(llm_name), "llm").otherwise("generated")


def normalise_alarm(x: ColumnOrName) -> Column:
    return F.concat(F.lit("E"), F.regexp_extract(col(x), r"([0-9]{3,4})", 1))


def normalise_sop(x: ColumnOrName) -> Column:
    rest = F.regexp_replace(F.regexp_replace(F.upper(F.trim(col(x))), r"^SOP[\s_-]*", ""), r"[\s_]+", "-")
    return F.concat(F.lit("SOP-"), rest)


def normalise_part(x: ColumnOrName) -> Column:
    """Upper case, separators as dashes; null without a digit."""
    out = F.regexp_replace(F.upper(F.trim(col(x))), r"[\s_]+", "-")
    return F.when(out.rlike("[0-9]"), out)


def normalise_model(prefix: ColumnOrName, number: ColumnOrName) -> Column:
    """Upper letters and number, a space between unless the prefix is one letter and the number begins with a digit."""
    p = F.upper(F.regexp_replace(col(prefix), r"[^A-Za-z]", ""))
    n = F.upper(F.regexp_replace(col(number), r"[\s_-]", ""))
    return F.concat(p, F.when((F.length(p) == 1) & n.rlike("^[0-9]"), "").otherwise(" "), n)


def extract_identifiers(text: ColumnOrName) -> Column:
    """map of type -> values: model, alarm, sop, part; ordered, distinct, types without a value left out.

    Priority alarm, SOP, part, model: what an earlier type matched is blanked before the next looks.
    """
    t = F.coalesce(col(text), F.lit(""))
    after_alarm = F.regexp_replace(t, ALARM, " \u0001 ")
    after_sop = F.regexp_replace(after_alarm, SOP, " \u0001 ")
    after_part = F.regexp_replace(after_sop, PART, " \u0001 ")
    alarms = F.transform(F.regexp_extract_all(t, F.lit(ALARM), F.lit(1)), lambda d: F.concat(F.lit("E"), d))
    sops = F.transform(F.regexp_extract_all(after_alarm, F.lit(SOP), F.lit(1)), normalise_sop)
    parts = F.transform(F.regexp_extract_all(after_sop, F.lit(PART), F.lit(1)), normalise_part)
    models = F.transform(model_names(after_part), lambda m: F.when(F.upper(m["prefix"]) != "SOP", normalise_model(m["prefix"], m["number"])))
    entries = F.array(*(F.struct(F.lit(k).alias("key"), F.array_distinct(F.array_compact(v)).alias("value")) for k, v in (("equipment_model", models), ("alarm_code", alarms), ("sop_code", sops), ("part_number", parts))))
    return F.map_from_entries(F.filter(entries, lambda e: F.size(e["value"]) > 0))


def record_identifiers(metadata: ColumnOrName, text: ColumnOrName) -> Column:
    """Metadata identifiers and those of the text, per type (10.5)."""
    none = F.array().cast("array<string>")
    return F.map_zip_with(col(metadata), extract_identifiers(text), lambda _, a, b: F.array_union(F.coalesce(a, none), F.coalesce(b, none)))


def contains_identifier(text: ColumnOrName, value: ColumnOrName) -> Column:
    """Whether the text holds the value, separators aside, bounded by characters that are no letters or digits (10.6)."""
    characters = F.split(F.regexp_replace(F.upper(col(value)), r"[^A-Z0-9]", ""), "")
    pattern = F.concat(F.lit("(?i)" + _EDGE_L), F.array_join(F.filter(characters, lambda c: c != ""), r"[\s_-]*"), F.lit(_EDGE_R))
    return F.coalesce(F.regexp_like(col(text), pattern), F.lit(False))


def compact_identifier(x: ColumnOrName) -> Column:
    return F.regexp_replace(F.upper(F.coalesce(col(x), F.lit(""))), r"[^A-Z0-9]", "")


def identifier_distance(a: ColumnOrName, b: ColumnOrName, most: int = 1) -> Column:
    """Edit distance of the compact forms, null beyond `most` (10.8)."""
    d = F.levenshtein(compact_identifier(a), compact_identifier(b), most)
    return F.when(d >= 0, d)


def compatible_format(kind: ColumnOrName, requested: ColumnOrName, candidate: ColumnOrName) -> Column:
    """Whether two identifiers of a type have the same shape: alarm and SOP prefixes, letters before digits for the rest (10.9)."""
    letters = [F.regexp_extract(compact_identifier(x), "^([A-Z]*)", 1) for x in (requested, candidate)]
    lengths = [F.length(x) for x in letters]
    return (
        F.when(col(kind) == "alarm_code", compact_identifier(candidate).rlike("^E[0-9]{3,4}$"))
        .when(col(kind) == "sop_code", compact_identifier(candidate).rlike("^SOP"))
        .when(col(kind) == "equipment_model", (F.abs(lengths[0] - lengths[1]) <= 1) & (lengths[1] > 0))
        .otherwise(compact_identifier(candidate).rlike("[0-9]"))
    )


def format_identifiers(identifiers: ColumnOrName) -> Column:
    """type: a, b; type: c (sorted by type)."""
    entries = F.array_sort(F.map_entries(col(identifiers)))
    return F.array_join(F.transform(entries, lambda e: F.concat(e["key"], F.lit(": "), F.array_join(e["value"], ", "))), "; ")


def append_identifiers(query: ColumnOrName, identifiers: ColumnOrName) -> Column:
    """The query followed by its labelled identifiers; unchanged without any (10.10)."""
    return F.when(F.size(col(identifiers)) > 0, F.concat(F.trim(col(query)), F.lit(" ["), format_identifiers(identifiers), F.lit("]"))).otherwise(col(query))


def suggestion_question(requested: ColumnOrName, suggested: ColumnOrName) -> Column:
    return F.format_string("No match for %s. Did you mean %s?", format_identifiers(requested), format_identifiers(suggested))


def not_found_question(requested: ColumnOrName) -> Column:
    return F.format_string("No match for %s. Please check the identifier.", format_identifiers(requested))


# --- Markdown and HTML (9.11-9.15) -------------------------------------------------------------------------------------------------------
IMAGE = r"!\[[^\]]*\]\(([^)\s]+)[^)]*\)"


def image_urls(text: ColumnOrName, url: ColumnOrName | None = None) -> Column:
    """URLs of Markdown images, after the row's own URL if that is an image; ordered, distinct."""
    found = F.regexp_extract_all(F.coalesce(col(text), F.lit("")), F.lit(IMAGE), F.lit(1))
    if url is not None:
        own = F.when(F.lower(col(url)).rlike(r"\.(png|jpe?g|gif|webp|bmp|svg)$"), F.array(col(url))).otherwise(F.array().cast("array<string>"))
        found = F.concat(F.coalesce(own, F.array().cast("array<string>")), found)
    return F.array_distinct(found)


def image_context(text: ColumnOrName, name: ColumnOrName, length: int = 100) -> Column:
    """Up to `length` characters on either side of the first Markdown image whose target holds the name; null without one."""
    quoted = F.concat(F.lit(r"!\[[^\]]*\]\([^)]*\Q"), col(name), F.lit(r"\E[^)]*\)"))
    at = F.regexp_instr(col(text), quoted)
    match = F.regexp_substr(col(text), quoted)
    before = F.substr(col(text), F.greatest(at - length, F.lit(1)), F.least(at - 1, F.lit(length)))
    return F.when(at > 0, F.struct(before.alias("before"), F.substr(col(text), at + F.length(match), F.lit(length)).alias("after")))


def rewrite_image(text: ColumnOrName, name: ColumnOrName, summary: ColumnOrName, url: ColumnOrName) -> Column:
    """Every ![..](..name..) becomes ![summary](url), both taken literally."""
    pattern = F.concat(F.lit(r"!\[[^\]]*\]\([^)]*\Q"), col(name), F.lit(r"\E[^)]*\)"))
    link = F.concat(F.lit("!["), col(summary), F.lit("]("), col(url), F.lit(")"))
    # the replacement is escaped: backslash and dollar have a meaning there
    return F.regexp_replace(col(text), pattern, F.regexp_replace(link, r"([\\$])", r"\\$1"))


def clean_fact(text: ColumnOrName) -> Column:
    """Without Markdown images and HTML tags, white space collapsed."""
    return collapse_spaces(F.regexp_replace(F.regexp_replace(F.coalesce(col(text), F.lit("")), r"!\[[^\]]*\]\([^)]*\)", " "), r"<[^>]+>", " "))


def html_text(html: ColumnOrName, separator: str = " ") -> Column:
    """Visible text: comments, scripts, styles and tags out, the five named entities and nbsp resolved, white space collapsed."""
    out = F.coalesce(col(html), F.lit(""))
    for pattern in (r"(?s)<!--.*?-->", r"(?is)<script\b.*?</script\s*>", r"(?is)<style\b.*?</style\s*>", r"(?s)<[^>]*>"):
        out = F.regexp_replace(out, pattern, " ")
    for name, to in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        out = F.replace(out, F.lit(name), F.lit(to))
    return F.trim(F.regexp_replace(out, r"\s+", separator))


# --- JSON, hashes, times, misc (10.20-10.28) ---------------------------------------------------------------------------------------------
def canonical_json(*columns: str) -> Column:
    """A JSON object with its keys in order; null fields are kept."""
    return F.to_json(F.struct(*(F.col(c).alias(c) for c in sorted(columns))), {"ignoreNullFields": "false"})


def payload_hash(*columns: str) -> Column:
    return F.sha2(canonical_json(*columns), 256)


def content_hash(x: ColumnOrName) -> Column:
    return F.sha2(F.coalesce(col(x), F.lit("")), 256)


def elapsed_ms(start: ColumnOrName, end: ColumnOrName) -> Column:
    """Milliseconds between two timestamps, 0 at least."""
    return F.greatest(F.lit(0).cast("long"), F.unix_millis(col(end)) - F.unix_millis(col(start)))


def clamp01(x: ColumnOrName) -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), col(x)))


def log_field(line: ColumnOrName, name: str) -> Column:
    """The value of name=value or "name": value in a log line; null without it."""
    found = F.regexp_extract(col(line), rf"""["']?{name}["']?\s*[=:]\s*["']?([^\s,"'}}]+)""", 1)
    return F.when(found != "", found)


def http_class(status: ColumnOrName) -> Column:
    s = col(status)
    return F.when(s.between(200, 299), "ok").when(s.between(500, 599), "retryable").otherwise("failed")


def truncated(x: ColumnOrName, most: int) -> Column:
    """The text, or if it has over `most` characters its first most - 20 (none for a smaller `most`) and a mark (2.10)."""
    mark = "...[truncated]"
    return F.when(F.length(col(x)) <= most, col(x)).otherwise(F.concat(F.left(col(x), F.lit(max(most - 20, 0))), F.lit(mark)))


def decode_decision(raw: ColumnOrName, allowed: list[str], *, extract: bool = True) -> Column:
    """struct(action, query, reason_code, error) from a model's raw text (10.22).

    Code fences go; with `extract` the first {...} is taken; the object must have exactly the three fields; action must be allowed.
    """
    text = F.trim(F.regexp_replace(F.trim(F.coalesce(col(raw), F.lit(""))), r"^```[a-zA-Z]*\s*|\s*```$", ""))
    body = F.regexp_extract(text, r"(?s)(\{.*?\})", 1) if extract else text
    keys = F.json_object_keys(body)
    obj = F.from_json(body, "action string, query string, reason_code string")
    exact = F.array_sort(keys) == F.array(F.lit("action"), F.lit("query"), F.lit("reason_code"))
    error = (
        F.when(text == "", "empty_output")
        .when(keys.isNull(), "invalid_json")
        .when(~exact, "invalid_fields")
        .when(~F.coalesce(obj["action"].isin(allowed), F.lit(False)), "action_not_allowed")
        .when(obj["reason_code"].isNull() | (F.trim(obj["reason_code"]) == ""), "invalid_reason_code")
    )
    ok = error.isNull()
    return F.struct(F.when(ok, obj["action"]).alias("action"), F.when(ok, obj["query"]).alias("query"), F.when(ok, obj["reason_code"]).alias("reason_code"), error.alias("error"))


def encode_decision(action: ColumnOrName, query: ColumnOrName, reason_code: ColumnOrName) -> Column:
    return F.to_json(F.struct(col(action).alias("action"), col(query).alias("query"), col(reason_code).alias("reason_code")), {"ignoreNullFields": "false"})
