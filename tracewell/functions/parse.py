"""Parsing of log lines into levels, times, components, columns and fields.

All functions take a column (or its name) and return a column; none needs a UDF.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Keywords by which lines are classified.
LEVELS = ["fatal", "error", "warning", "info", "debug", "verbose", "trace"]
LEVEL_WORDS = {
    "reader": [
        ("fatal", "FATAL|PANIC|EMERGENCY|EMERG"),
        ("error", "ERROR|CRITICAL|CRIT|SEVERE|EXCEPTION"),
        ("warning", "WARN|WARNING|NOTICE"),
        ("info", "INFO|INFORMATION"),
        ("debug", "DEBUG|DBG"),
        ("verbose", "VERBOSE|VERB"),
        ("trace", "TRACE"),
    ],
    "analyzer": [
        ("fatal", "FATAL|PANIC|EMERGENCY|EMERG"),
        ("error", "ERROR|CRITICAL|CRIT|EXCEPTION"),
        ("warning", "WARN|WARNING|NOTICE"),
        ("info", "INFO"),
        ("debug", "DEBUG|DBG"),
        ("verbose", "VERBOSE|VERB"),
        ("trace", "TRACE"),
    ],
    "severity": [
        ("fatal", "FATAL|PANIC|EMERGENCY|EMERG"),
        ("error", "ERROR|CRITICAL|CRIT|SEVERE|EXCEPTION"),
        ("warning", "WARN|WARNING|NOTICE"),
    ],
}
LEVEL_SYNONYMS = {
    "fatal": ["fatal", "panic", "emergency", "alert", "emerg"],
    "error": ["error", "critical", "severe", "crit", "exception"],
    "warning": ["warn", "warning", "notice"],
    "info": ["info", "information", "informational"],
    "debug": ["debug", "dbg", "d"],
    "verbose": ["verbose", "verb", "v", "fine", "finer"],
    "trace": ["trace", "finest", "silly"],
}
CRASH_WORDS = {
    "analyzer": r"\b(fatal|crash|exception|panic|oom|out.of.memory|segfault|abort|core.dump|stack.overflow|unhandled|killed|sigsegv)\b",
    "traceback": r"\b(fatal|crash|exception|panic|oom|segfault|abort|sigsegv|sigabrt|unhandled|stack\s*trace)\b",
}
CRASH_LIST = ["fatal", "panic", "crash", "exception", "segfault", "abort", "oom", "killed", "core dump"]
HEADER_WORDS = ["packetid", "sessionid", "timestamp", "level", "message", "channel", "source", "component", "logger", "time"]
ROLE_WORDS = {
    "timestamp": ["time", "timestamp", "date", "datetime", "loggertime", "tracetime"],
    "level": ["level", "severity", "loglevel", "priority"],
    "message": ["message", "msg", "text", "content", "description"],
    "source": ["source", "process", "thread", "origin", "class"],
    "channel": ["channel", "component", "module", "category", "logger"],
}
STOP_WORDS = (
    "should must shall will would could the this that with from when then than have been being appear appears shown show "
    "shows showing display displayed mode screen view page state and but for was were its into onto need needs not visible"
).split()
MONTHS = ["Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec"]

# Patterns of times, numbers and fields.
ISO = r"\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}(?:[.,]\d{1,9})?"
ISO_SLASH = r"\d{4}[-/]\d{2}[-/]\d{2}[T ]\d{2}:\d{2}:\d{2}"
EURO = r"(\d{2}\.\d{2}\.\d{4})\s+(\d{2}:\d{2}:\d{2})"
SYSLOG = r"([A-Z][a-z]{2})\s+(\d{1,2})\s+(\d{2}:\d{2}:\d{2})"
NUMERIC = r"^[+-]?\d+(\.\d+)?([eE][+-]?\d+)?$"
FIELD_EQ = r"([A-Za-z_][\w.\-]*)\s*=\s*(\"(?:[^\"\\]|\\.)*\"|'[^']*'|\[[^\]]*\]|\{[^}]*\}|[^\s,;]+)"
FIELD_COLON = r"([A-Za-z_][\w.\-]*)\s*:\s*(\"(?:[^\"\\]|\\.)*\"|'[^']*'|\[[^\]]*\]|[^\s,;]+)"
# Patterns of what is redacted, in order, and the prefix of their placeholders.
REDACTIONS = [
    (r"\b\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}\b", "IP"),
    (r"\b(?:[0-9a-fA-F]{1,4}:){7}[0-9a-fA-F]{1,4}\b", "IPV6"),
    (r"\b(?:[0-9a-fA-F]{1,4}:){2,6}(?::[0-9a-fA-F]{1,4}){1,5}\b", "IPV6"),
    (r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b", "EMAIL"),
    (r"\b[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}\b", "UUID"),
    (r"\beyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\b", "TOKEN"),
    (r"\b[0-9a-fA-F]{32,}\b", "KEY"),
]


def _c(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _whole(text: str | Column, pattern: str, group: int = 0) -> Column:
    """A group of the first match, or null without a match (regexp_extract gives '')."""
    return F.when(_c(text).rlike(pattern), F.regexp_extract(_c(text), pattern, group))


def _stamp(text: Column, form: str) -> Column:
    return F.try_to_timestamp(text, F.lit(form)).cast("timestamp_ntz")


def _iso(sample: Column) -> Column:
    m = F.regexp_extract(sample, ISO, 0)
    whole, part = F.translate(F.substring(m, 1, 19), "T", " "), F.rpad(F.substring(m, 21, 3), 3, "0")
    return _stamp(F.concat_ws(".", whole, part), "yyyy-MM-dd HH:mm:ss.SSS")


def _euro(sample: Column) -> Column:
    return _stamp(F.concat_ws(" ", F.regexp_extract(sample, EURO, 1), F.regexp_extract(sample, EURO, 2)), "dd.MM.yyyy HH:mm:ss")


def parse_ts(text: str | Column, year: int = 1970) -> Column:
    """The time in the first 60 characters: ISO, else European, else syslog form.

    Fractions are cut to milliseconds; a syslog line takes ``year``.  Dates that do not
    exist (month 13) give null rather than rolling over.
    """
    s = F.substring(_c(text), 1, 60)
    day = F.concat_ws(" ", F.lit(f"{year:04d}"), *(F.regexp_extract(s, SYSLOG, k) for k in (1, 2, 3)))
    return F.when(s.rlike(ISO), _iso(s)).when(s.rlike(EURO), _euro(s)).when(s.rlike(SYSLOG), _stamp(day, "yyyy MMM d HH:mm:ss"))


def ts_str(text: str | Column) -> Column:
    """The text of the time that :func:`parse_ts` reads."""
    s = F.substring(_c(text), 1, 60)
    return F.coalesce(_whole(s, ISO), _whole(s, EURO), _whole(s, SYSLOG))


def parse_ts_seconds(text: str | Column) -> Column:
    """The baseline's form: dashes or slashes, whole seconds; else the European form."""
    s = F.substring(_c(text), 1, 60)
    iso = _stamp(F.translate(F.regexp_extract(s, ISO_SLASH, 0), "T/", " -"), "yyyy-MM-dd HH:mm:ss")
    return F.when(s.rlike(ISO_SLASH), iso).when(s.rlike(EURO), _euro(s))


def detect_level(text: str | Column, variant: str = "reader") -> Column:
    """Level by keyword, most severe first; null without one.  ``severity`` looks at the whole
    line and knows three levels, the others look at 200 characters."""
    s = _c(text) if variant == "severity" else F.substring(_c(text), 1, 200)
    out = F.lit(None).cast("string")
    for level, words in reversed(LEVEL_WORDS[variant]):
        out = F.when(F.upper(s).rlike(rf"\b({words})\b"), level).otherwise(out)
    return out


def severity_rank(text: str | Column) -> Column:
    level = detect_level(text, "severity")
    return F.when(level == "fatal", 3).when(level == "error", 2).when(level == "warning", 1).otherwise(0)


def normalize_level(raw: str | Column) -> Column:
    out = F.lit(None).cast("string")
    for level, names in LEVEL_SYNONYMS.items():
        out = F.when(_c(raw).isin(names), level).otherwise(out)
    return out


def crash_keyword(text: str | Column, variant: str = "analyzer") -> Column:
    """The first crash keyword in lower case; ``list`` takes the first of a list that occurs."""
    if variant == "list":
        low = F.lower(_c(text))
        return F.coalesce(*[F.when(F.contains(low, F.lit(w)), w) for w in CRASH_LIST])
    return F.lower(_whole(text, "(?i)" + CRASH_WORDS[variant], 1))


def component(text: str | Column) -> Column:
    """A bracketed name in the first 120 characters."""
    return _whole(F.substring(_c(text), 1, 120), r"\[([A-Za-z][A-Za-z0-9_.\-/]{1,40})\]", 1)


def bracket_component(text: str | Column) -> Column:
    return _whole(text, r"\[([A-Za-z][\w.-]{1,30})\]", 1)


def simplify_source(source: str | Column) -> Column:
    head = F.substring_index(_c(source), ".", 1)
    return F.when(head != "", head).otherwise(_c(source))


def split_columns(text: str | Column, delimiter: str) -> Column:
    """Cells of a line: by runs of white space, tabs, or another mark that quotes protect."""
    c = _c(text)
    if delimiter == " ":
        return F.split(F.trim(c), r"\s+")
    if delimiter == "\t":
        return F.split(c, "\t")
    d = re.escape(delimiter)
    cells = F.regexp_extract_all(F.concat(F.lit(delimiter), c), F.lit(rf'{d}("(?:[^"]|"")*"|[^{d}]*)'), F.lit(1))
    return F.transform(cells, lambda x: F.when(x.rlike('^".*"$'), F.replace(F.substr(x, F.lit(2), F.length(x) - 2), F.lit('""'), F.lit('"'))).otherwise(x))


def project_columns(text: str | Column, delimiter: str, visible: list[bool]) -> Column:
    """The line without its hidden columns; columns beyond the list stay."""
    shown = F.array(*[F.lit(v) for v in visible])
    cells = F.filter(split_columns(text, delimiter), lambda x, i: F.coalesce(F.get(shown, i), F.lit(True)))
    if delimiter in (" ", "\t"):
        return F.array_join(cells, delimiter)
    quoted = F.transform(
        cells,
        lambda x: F.when(F.contains(x, F.lit(delimiter)) | F.contains(x, F.lit('"')), F.concat(F.lit('"'), F.replace(x, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(x),
    )
    return F.array_join(quoted, delimiter)


def is_header(text: str | Column) -> Column:
    low = F.lower(_c(text))
    return sum((F.contains(low, F.lit(w)).cast("int") for w in HEADER_WORDS), F.lit(0)) >= 2


def header_role(name: str | Column) -> Column:
    low = F.lower(F.trim(_c(name)))
    out = F.lit("other")
    for role, words in reversed(ROLE_WORDS.items()):
        out = F.when(low.rlike("|".join(words)), role).otherwise(out)
    return out


def _unquoted(x: Column) -> Column:
    return F.regexp_replace(x, r"""(?s)^(?:"(.*)"|'(.*)')$""", "$1$2")


def _found(text: Column, pattern: str, group: int) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def _json(text: Column) -> Column:
    """A JSON object's members that are not null, as text; null for other lines."""
    flat = F.when(F.trim(text).rlike(r"(?s)^\{.*\}$"), F.from_json(text, "map<string,string>"))
    return F.map_filter(flat, lambda k, v: v.isNotNull())


def extract_fields(text: str | Column) -> Column:
    """Map of a line's fields: a JSON object flattened one level, else ``k=v`` and then ``k: v``
    pairs.  Of repeated keys the first counts; JSON nulls are left out."""
    c = _c(text)
    both = F.struct(
        F.concat(_found(c, FIELD_EQ, 1), _found(c, FIELD_COLON, 1)).alias("k"), F.concat(_found(c, FIELD_EQ, 2), _found(c, FIELD_COLON, 2)).alias("v")
    )
    value = lambda p, k: _unquoted(F.get(p["v"], (F.array_position(p["k"], k) - 1).cast("int")))
    scanned = _bound(both, lambda p: F.map_from_arrays(F.array_distinct(p["k"]), F.transform(F.array_distinct(p["k"]), lambda k: value(p, k))))
    return _bound(_json(c), lambda known: F.when(F.size(known) > 0, known).otherwise(scanned))


def field(text: str | Column, name: str) -> Column:
    """One field of a line, as :func:`extract_fields` has it, without building a map of all."""
    c = _c(text)

    def scan(pattern: str) -> Column:
        at = F.array_position(_found(c, pattern, 1), F.lit(name)).cast("int")
        return F.get(_found(c, pattern, 2), at - 1)

    scanned = _unquoted(F.when(F.contains(c, F.lit(name)), F.coalesce(scan(FIELD_EQ), scan(FIELD_COLON))))
    known = _json(c)
    return F.when(F.trim(c).startswith("{"), F.when(F.size(known) > 0, known[name]).otherwise(scanned)).otherwise(scanned)


def value_of(text: str | Column, field_name: str | None = None, pattern: str | None = None) -> Column:
    """A line's value for a series: of a field, or what a pattern finds (its first group)."""
    if pattern is not None:
        return matched(text, pattern)
    if field_name is None:
        raise ValueError("a field or a pattern is needed")
    return field(text, field_name)


def matched(text: str | Column, pattern: str) -> Column:
    """Group 1 of a pattern, or the whole match if it has no group."""
    return _whole(text, pattern, 1 if re.compile(pattern).groups else 0)


def classify_value(raw: str | Column) -> Column:
    c = _c(raw)
    return (
        F.when(c.rlike("(?i)^(true|false)$"), "boolean").when(c.rlike(NUMERIC), "numeric")
        .when(c.startswith("[") & c.endswith("]"), "array").otherwise("string")
    )


def to_num(raw: str | Column) -> Column:
    """A number; null for other texts and for numbers beyond a double."""
    read = F.transform(F.array(_c(raw)), lambda r: F.when(r.rlike(NUMERIC), r.try_cast("double")))  # reads raw once
    return F.get(F.filter(read, lambda x: F.abs(x) < float("inf")), F.lit(0))


def series_num(raw: str | Column) -> Column:
    low = F.lower(_c(raw))
    return F.coalesce(to_num(raw), F.when(low == "true", 1.0).when(low == "false", 0.0))


def relative_seconds(text: str | Column) -> Column:
    return _whole(text, r"^\s*(\d+(?:\.\d+)?)\s", 1).try_cast("double")


def axis_value(spec: str, text: str = "text") -> Column:
    """The x of a line: ``line``, ``time`` (milliseconds), ``relative``, or ``field:name``."""
    if spec == "line":
        return F.col("line_no").cast("double")
    if spec == "time":
        return epoch_ms(parse_ts(text)).cast("double")
    if spec == "relative":
        return relative_seconds(text)
    return series_num(field(text, spec.removeprefix("field:")))


def epoch_ms(ts: str | Column) -> Column:
    return F.unix_millis(_c(ts).cast("timestamp"))


def grok(template: str) -> tuple[str, list[str]]:
    """``%{name}`` and ``%{name:regex}`` placeholders to a pattern and unique field names."""
    names: list[str] = []
    parts = re.split(r"(%\{[^}:]+(?::(?:[^{}]|\{[^}]*\})+)?\})", template)
    fields = [k for k, x in enumerate(parts) if x.startswith("%{")]
    out = ""
    for k, part in enumerate(parts):
        if k in fields:
            name, _, rule = part[2:-1].partition(":")
            name = re.sub(r"\W+", "_", name.strip()) or "field"
            unique, n = name, 2
            while unique in names:
                unique, n = f"{name}_{n}", n + 1
            names.append(unique)
            rule = re.sub(r"\((?!\?)", "(?:", rule)
            out += f"({rule or ('.*' if k == fields[-1] else '.*?')})"
        else:
            out += r"\s+".join(map(re.escape, re.split(r"\s+", part)))
    return f"^{out}" + ("$" if fields and fields[-1] == len(parts) - 2 and not parts[-1] else ""), names


def pattern_columns(text: str | Column, pattern: str, names: list[str] | None = None) -> list[Column]:
    """One column for each group: named, else ``col1..n``, else the whole ``match``; null where
    the pattern does not match, '' where only the group is missing."""
    compiled = re.compile(pattern)
    plain = re.sub(r"\(\?P?<([A-Za-z_]\w*)>", "(", pattern)
    if not compiled.groups:
        return [_whole(text, plain).alias("match")]
    by_number = {v: k for k, v in compiled.groupindex.items()}
    labels = names or [by_number.get(k, f"col{k}") for k in range(1, compiled.groups + 1)]
    return [_whole(text, plain, k).alias(n) for k, n in enumerate(labels, 1)]


def line_template(text: str | Column) -> Column:
    """The line without its leading time and with ids and numbers as ``#``; 120 characters."""
    c = _c(text)
    stamp = ts_str(c)
    t = F.when(c.startswith(stamp), F.substr(c, F.length(stamp) + 1)).otherwise(c)
    for pattern, by in [
        (r"\b[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}\b", "#"),
        (r"0x[0-9a-fA-F]+", "#"),
        (r"\b[0-9a-fA-F]{6,}\b", "#"),
        (r"\d+", "#"),
        (r"#[#\s.:,_\-/]*#", "#"),
        (r"\s+", " "),
    ]:
        t = F.regexp_replace(t, pattern, by)
    return F.substring(F.trim(t), 1, 120)


def template_literal(template: str | Column) -> Column:
    """The part between ``#`` with the most letters, the first of equals; '' without letters."""
    parts = F.transform(F.split(_c(template), "#"), lambda x: F.trim(x))
    start = F.struct(F.lit("").alias("best"), F.lit(0).alias("letters"))
    step = lambda acc, p: F.when(
        F.regexp_count(p, F.lit("[A-Za-z]")) > acc["letters"], F.struct(p.alias("best"), F.regexp_count(p, F.lit("[A-Za-z]")).alias("letters"))
    ).otherwise(acc)
    return F.aggregate(parts, start, step)["best"]


def noise_key(text: str | Column) -> Column:
    return F.regexp_replace(F.regexp_replace(_c(text), r"^[0-9:.\-T ]+", ""), r"\d+", "#")


def _replaced(text: Column, pattern: str, prefix: str) -> Column:
    found = F.array_distinct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)))
    longest_first = F.reverse(F.array_sort(F.transform(found, lambda x: F.struct(F.length(x).alias("n"), x.alias("v")))))
    mark = lambda v: F.concat(F.lit(f"[{prefix}-"), F.substring(F.sha2(v, 256), 1, 8), F.lit("]"))
    return F.aggregate(longest_first, text, lambda acc, x: F.replace(acc, x["v"], mark(x["v"])))


def redact_hashed(text: str | Column) -> Column:
    """Secrets replaced by placeholders with a hash of the value: equal values, equal
    placeholders, on any cluster and in streams, without a dictionary."""
    out = _c(text)
    for pattern, prefix in REDACTIONS:
        out = _bound(out, lambda t, a=pattern, b=prefix: F.when(t.rlike(a), _replaced(t, a, b)).otherwise(t))
    return out


def _bound(value: Column, use) -> Column:
    """``use(value)`` with the value computed once, however often it is used."""
    return F.get(F.transform(F.array(value), lambda t: use(t)), F.lit(0))


def muted(text: str | Column, patterns: list[str]) -> Column:
    """Whether the line contains any of the patterns, whatever their case; blank ones do not count."""
    wanted = [p.lower() for p in patterns if p.strip()]
    low = F.lower(_c(text))
    return F.coalesce(F.exists(F.array(*map(F.lit, wanted)), lambda p: F.contains(low, p)), F.lit(False)) if wanted else F.lit(False)


def wall_clock(ts: str | Column) -> Column:
    return F.date_format(_c(ts).cast("timestamp"), "yyyy-MM-dd HH:mm:ss.SSS")


def duration_text(seconds: str | Column) -> Column:
    s = F.round(_c(seconds)).cast("long")
    h, m, r = F.floor(s / 3600).cast("long"), F.floor(s % 3600 / 60).cast("long"), s % 60
    return (
        F.when(s < 60, F.concat(s.cast("string"), F.lit("s")))
        .when(s < 3600, F.concat(m.cast("string"), F.lit("m "), r.cast("string"), F.lit("s")))
        .otherwise(F.concat(h.cast("string"), F.lit("h "), m.cast("string"), F.lit("m")))
    )


def keywords(text: str | Column, most: int = 6) -> Column:
    """The first different words of three letters or more that are no stop-words."""
    words = F.regexp_extract_all(F.lower(_c(text)), F.lit("[a-z][a-z0-9_.-]{2,}"), F.lit(0))
    return F.slice(F.array_distinct(F.filter(words, lambda w: ~w.isin(STOP_WORDS))), 1, most)
