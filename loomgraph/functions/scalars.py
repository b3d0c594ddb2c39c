"""Scalar functions of the graph and ranking operators, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Paths that weigh less as change destinations.
GENERATED_FILES = ("cargo.lock", "package-lock.json", "yarn.lock", "pnpm-lock.yaml", "go.sum", "poetry.lock")
MINOR_FILES = ("changelog.md", "readme.md", "cargo.toml")


def trailing_segment(qualified: Column) -> Column:
    return F.element_at(F.split(qualified, "::"), -1)


def parent_qualified(qualified: Column) -> Column:
    """What stands before the last ``::``; null at the top."""
    return F.when(F.instr(qualified, "::") > 0, F.regexp_replace(qualified, "::(?:(?!::).)*$", ""))


def symbol_selector(path: Column, qualified: Column, kind: Column) -> Column:
    return F.concat(F.lit("symbol:"), path, F.lit("#"), qualified, F.lit(":"), kind)


def parse_selector(text: Column) -> dict[str, Column]:
    """form, path, symbol, symbol_kind of a selector; nulls where it isn't one."""
    body = F.regexp_extract(text, r"^(dir|file|symbol|module|command):(.*)$", 2)
    form = F.nullif(F.regexp_extract(text, r"^(dir|file|symbol|module|command):", 1), F.lit(""))
    is_symbol = form == "symbol"
    return {
        "form": form,
        "path": F.when(is_symbol, F.regexp_extract(body, r"^([^#]*)#", 1)).otherwise(body),
        "symbol": F.when(is_symbol, F.regexp_extract(body, r"^[^#]*#(.*):[^:]*$", 1)),
        "symbol_kind": F.when(is_symbol, F.regexp_extract(body, r":([^:]*)$", 1)),
    }


def normalize_path(path: Column) -> Column:
    """Forward slashes, no empty or ``.`` segments, ``..`` folded; leading ``..`` of a relative path stays."""
    parts = F.filter(F.split(F.replace(path, F.lit("\\"), F.lit("/")), "/"), lambda p: (p != "") & (p != "."))
    absolute = F.startswith(F.replace(path, F.lit("\\"), F.lit("/")), F.lit("/"))
    empty = F.array().cast("array<string>")
    folded = F.aggregate(
        parts,
        empty,
        lambda done, p: F.when(p != "..", F.concat(done, F.array(p)))
        .when((F.size(done) > 0) & (F.element_at(F.concat(F.array(F.lit("..")), done), -1) != ".."), F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))))
        .when(absolute, done)
        .otherwise(F.concat(done, F.array(p))),
    )
    return F.concat(F.when(absolute, F.lit("/")).otherwise(F.lit("")), F.array_join(folded, "/"))


def normalize_module(module: Column) -> Column:
    """``.`` and ``/`` as ``::``; empty segments dropped."""
    return F.array_join(F.filter(F.split(module, r"::|\.|/"), lambda p: p != ""), "::")


def tokens(text: Column) -> Column:
    """Distinct lower-cased ASCII words; one trailing s of words over four letters is dropped."""
    words = F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda w: w != "")
    return F.array_distinct(F.transform(words, lambda w: F.when((F.length(w) > 4) & w.endswith("s"), F.regexp_replace(w, "s$", "")).otherwise(w)))


def lexical_similarity(query: Column, document: Column) -> Column:
    """Share of the query's tokens that the document has; 0 for an empty query."""
    return F.when(F.size(query) > 0, F.size(F.array_intersect(query, document)) / F.size(query)).otherwise(0.0)


def artifact_discount(path: Column) -> Column:
    name = F.lower(F.element_at(F.split(path, "/"), -1))
    return F.when(name.isin(*GENERATED_FILES), 0.15).when(name.isin(*MINOR_FILES), 0.55).otherwise(1.0)


def recency(distance: Column) -> Column:
    """Halves every 50 deliveries."""
    return F.pow(F.lit(0.5), distance / 50)


def ambiguity(count: Column) -> Column:
    return 1 / F.sqrt(F.greatest(count, F.lit(1)))


def ubiquity(prevalence: Column, total: Column) -> Column:
    return 1 / (1 + 2 * prevalence / total)


def evidence_weight(verified: Column) -> Column:
    return F.when(verified, 1.0).otherwise(0.55)


def commit_text_relevance(similarity: Column) -> Column:
    return 0.5 * F.pow(similarity, F.lit(2.0))


def association(observed: Column, expected: Column, kappa: float = 1.0) -> Column:
    """Smoothed positive pointwise mutual information."""
    return F.greatest(F.lit(0.0), F.log((observed + kappa) / (expected + kappa)))


def round6(x: Column) -> Column:
    return F.round(x, 6)


def cited_task_ids(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(text, F.lit(r"\[([A-Z][A-Z0-9]*-\d+)\]"), F.lit(1)))


def is_notable_string(value: Column) -> Column:
    """Six characters at least, with a letter or digit, and not a format string without letters."""
    bare = F.regexp_replace(value, r"\{[^}]*\}|%[a-z]", "")
    return (F.length(value) >= 6) & value.rlike("[A-Za-z0-9]") & bare.rlike("[A-Za-z]")


def slugify(heading: Column) -> Column:
    slug = F.trim(F.regexp_replace(F.regexp_replace(F.lower(heading), "[^a-z0-9 _-]+", ""), "[ _-]+", "-"))
    slug = F.regexp_replace(slug, "^-+|-+$", "")
    return F.when(slug == "", "section").otherwise(slug)


def kebab_case(name: Column) -> Column:
    return F.lower(F.regexp_replace(F.regexp_replace(name, "([a-z0-9])([A-Z])", "$1-$2"), "_", "-"))


def normalize_test_name(name: Column) -> Column:
    """One test prefix, then one test suffix, taken off."""
    return F.regexp_replace(F.regexp_replace(name, "^(?:test_|Test|test)", ""), "(?:_test|Tests?|_spec|Spec)$", "")


def shared_dir_depth(a: Column, b: Column) -> Column:
    """Leading directories that two paths share."""
    left, right = F.split(a, "/"), F.split(b, "/")
    upto = F.least(F.size(left), F.size(right)) - 1
    same = F.aggregate(
        F.sequence(F.lit(0), F.greatest(upto - 1, F.lit(0))),
        F.struct(F.lit(0).alias("n"), F.lit(True).alias("on")),
        lambda acc, i: F.struct(
            (acc["n"] + F.when(acc["on"] & (i < upto) & (F.get(left, i) == F.get(right, i)), 1).otherwise(0)).alias("n"),
            (acc["on"] & (F.get(left, i) == F.get(right, i))).alias("on"),
        ),
        lambda acc: acc["n"],
    )
    return same.cast("long")


def signature_line(text: Column) -> Column:
    """First line that isn't blank, trimmed; empty if none."""
    lines = F.filter(F.transform(F.split(text, "\n"), lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")), lambda x: x != "")
    return F.coalesce(F.get(lines, F.lit(0)), F.lit(""))


def body_normalize(body: Column, identifier: Column) -> Column:
    """Own name as a marker, ASCII white space deleted: equal for bodies that differ by a rename."""
    marked = F.regexp_replace(body, F.concat(F.lit(r"(?<![A-Za-z0-9_])\Q"), identifier, F.lit(r"\E(?![A-Za-z0-9_])")), F.lit("<identifier>"))
    return F.regexp_replace(marked, r"[ \t\r\n\f\x0B]+", "")


def snippet(line: Column, limit: int = 160) -> Column:
    text = F.regexp_replace(line, r"^\s+|\s+$", "")
    return F.when(F.length(text) > limit, F.concat(F.substring(text, 1, limit), F.lit("…"))).otherwise(text)


def line_of_offset(line_starts: Column, offset: Column) -> Column:
    """1-based line of a byte offset, given the sorted starts of the lines."""
    return F.size(F.filter(line_starts, lambda x: x <= offset)).cast("long")


def is_test_path(path: Column) -> Column:
    """A test directory, or a file whose stem starts or ends as tests do."""
    low = F.lower(path)
    return low.rlike(r"(?:^|/)(?:test|tests|spec|specs|__tests__)/") | low.rlike(r"(?:^|/)(?:test_[^/]*|[^/]*(?:test|tests|_spec|\.spec))(?:\.[^./]*)?$")


def is_test_symbol(name: Column, kind: Column) -> Column:
    return (kind == "test") | name.rlike("^[Tt]est")


def category(kind: Column, confidence: Column) -> Column:
    """Evidence category of an edge; the order of strength is resolved_call, observed_reference, import_relationship, heuristic_match, runtime_invocation."""
    return (
        F.when(kind == "runtime_invocation", "runtime_invocation")
        .when(confidence == "fuzzy_name", "heuristic_match")
        .when(kind == "use", "import_relationship")
        .when(kind == "call", "resolved_call")
        .otherwise("observed_reference")
    )


def redact(text: Column, mask: str = "[REDACTED_SECRET]") -> Column:
    """Credentials masked: private-key blocks, passwords in URLs, bearer tokens, and tokens of well-known prefixes."""
    out = F.regexp_replace(text, r"(?s)-----BEGIN ([A-Z ]*PRIVATE KEY)-----.*?-----END \1-----", mask)
    out = F.regexp_replace(out, r"(?<![A-Za-z0-9_-])([A-Za-z][A-Za-z0-9+.-]*://[^\s/:@]*:)[^\s/@]+(?=@)", f"$1{mask}")
    out = F.regexp_replace(out, r"(?i)(authorization: bearer )[^\s\"']+", f"$1{mask}")
    out = F.regexp_replace(out, r"(?<![A-Za-z0-9_-])(?:ghp_|gho_|github_pat_|glpat-|xoxb-|xoxp-)[A-Za-z0-9_-]{12,}", mask)
    out = F.regexp_replace(out, r"(?<![A-Za-z0-9_-])(?:sk-proj-|sk-)[A-Za-z0-9]{20,}", mask)
    return F.regexp_replace(out, r"(?<![A-Za-z0-9_-])AKIA[A-Z0-9]{16}(?![A-Za-z0-9_-])", mask)


def covered_lines(ranges: Column) -> Column:
    """Lines in the union of inclusive (first, last) ranges."""
    done = F.aggregate(
        F.sort_array(ranges),
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("upto")),
        lambda a, r: F.struct(
            (a["n"] + F.greatest(F.lit(0).cast("long"), r["last"] - F.greatest(r["first"] - 1, a["upto"]))).cast("long").alias("n"),
            F.greatest(a["upto"], r["last"]).cast("long").alias("upto"),
        ),
        lambda a: a["n"],
    )
    return done


def parse_timestamp(text: Column) -> dict[str, Column]:
    """Epoch seconds and nanoseconds of RFC 3339 with an offset, or of ``unix:`` seconds."""
    unix = F.regexp_extract(text, r"^unix:(-?\d+)$", 1)
    base = F.regexp_extract(text, r"^(\d{4}-\d\d-\d\d)[Tt ](\d\d:\d\d:\d\d)", 1)
    clock = F.regexp_extract(text, r"^(\d{4}-\d\d-\d\d)[Tt ](\d\d:\d\d:\d\d)", 2)
    zone = F.regexp_replace(F.regexp_extract(text, r"([Zz]|[+-]\d\d:\d\d)$", 1), "[Zz]", "+00:00")
    fraction = F.regexp_extract(text, r"\.(\d{1,9})", 1)
    offset = F.when(zone.startswith("-"), -1).otherwise(1) * (F.try_element_at(F.split(F.substring(zone, 2, 5), ":"), F.lit(1)).try_cast("long") * 3600 + F.try_element_at(F.split(F.substring(zone, 2, 5), ":"), F.lit(2)).try_cast("long") * 60)
    seconds = F.unix_timestamp(F.try_to_timestamp(F.concat_ws(" ", base, clock), F.lit("yyyy-MM-dd HH:mm:ss"))) - offset
    return {
        "seconds": F.when(unix != "", unix.try_cast("long")).otherwise(seconds),
        "nanos": F.when(unix != "", F.lit(0).cast("long")).otherwise(F.rpad(fraction, 9, "0").try_cast("long")),
    }


def flatten_json_keys(text: Column, depth: int = 4) -> Column:
    """Dotted key paths of a JSON object, objects descended, arrays not."""
    level = F.transform(F.coalesce(F.json_object_keys(text), F.array().cast("array<string>")), lambda k: k)
    found = level
    for _ in range(depth - 1):
        level = F.flatten(
            F.transform(
                level,
                lambda p: F.transform(
                    F.coalesce(F.json_object_keys(F.call_function("get_json_object", text, F.concat(F.lit("$."), p))), F.array().cast("array<string>")),
                    lambda k: F.concat(p, F.lit("."), k),
                ),
            )
        )
        found = F.concat(found, level)
    return F.sort_array(found)


def path_source(categories: Column) -> Column:
    """What a path of edges of these categories shows: no edge, calls alone, an import somewhere, or other references."""
    return (
        F.when(F.size(categories) == 0, "changed_symbol")
        .when(F.forall(categories, lambda c: c == "resolved_call"), "call_path")
        .when(F.exists(categories, lambda c: c == "import_relationship"), "import_relationship")
        .otherwise("reference_path")
    )


def base_weight(mode: Column, lines: Column, symbol_lines: Column, diff_lines: Column) -> Column:
    """Weight of a changed context: presence alone, the share of the symbol that changed (one line at least), or its share of the whole diff."""
    one = F.greatest(lines, F.lit(1))
    return F.when(mode == "presence", F.lit(1.0)).when(mode == "symbol_fraction", F.try_divide(one, symbol_lines)).otherwise(F.try_divide(lines, diff_lines))


def whitespace_only(removed: Column, added: Column) -> Column:
    """Whether two lines differ in white space alone."""
    bare = lambda x: F.regexp_replace(x, r"[ \t\r\n\f\x0B]+", "")
    return (removed != added) & (bare(removed) == bare(added))
