"""Column functions on source text and names.  Everything here stays in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def content_hash(content: Column, normalized: Column | None = None) -> Column:
    """SHA-256 of the normalised text where there is one, else of the content; null counts as empty."""
    first = F.when(normalized != "", normalized) if normalized is not None else F.lit(None).cast("string")
    return F.sha2(F.coalesce(first, content, F.lit("")), 256)


def squeeze(text: Column, underscores: bool = False) -> Column:
    """Lower case without blanks, line ends and tabs, and without underscores if asked."""
    return F.translate(F.lower(text), " \t\n_" if underscores else " \t\n", "")


def without_comments(code: Column) -> Column:
    """Each line up to its first #, stripped; empty lines dropped."""
    line = lambda x: F.regexp_replace(F.substring_index(x, "#", 1), r"(?U)^\s+|\s+$", "")
    return F.array_join(F.filter(F.transform(F.split(code, "\n", -1), line), lambda x: x != ""), "\n")


def skeleton(code: Column) -> Column:
    """Comments and triple-quoted text removed, white space collapsed, every identifier called VAR, lower case."""
    x = F.regexp_replace(code, r"(?md)#.*$", "")
    x = F.regexp_replace(x, r'(?s)""".*?"""', "")
    x = F.regexp_replace(x, r"(?s)'''.*?'''", "")
    x = F.regexp_replace(x, r"(?U)\s+", " ")
    return F.lower(F.btrim(F.regexp_replace(x, r"(?U)\b[a-zA-Z_]\w*\b", "VAR")))


def length_bucket(text: Column) -> Column:
    return F.when(F.length(text) < 100, "short").when(F.length(text) < 500, "medium").otherwise("long")


def feature_key(content: Column, name: Column) -> Column:
    """Blocking key: length bucket, squeezed start of the content, start of the name."""
    named = F.coalesce(F.when(name != "", name), F.lit("unknown"))
    return F.concat_ws("_", length_bucket(content), F.replace(F.lower(F.substring(content, 1, 10)), F.lit(" "), F.lit("")), F.substring(named, 1, 5))


def prefix_key(name: Column) -> Column:
    """What stands before the first underscore, else the first three characters."""
    return F.when(F.instr(name, "_") > 0, F.substring_index(name, "_", 1)).otherwise(F.substring(name, 1, 3))


def analysis_key(name: Column) -> Column:
    """Group key for a judge: the prefix, or whether the name is short."""
    return F.when(F.instr(name, "_") > 0, F.concat(F.lit("prefix_"), F.substring_index(name, "_", 1))).when(F.length(name) < 10, "short_names").otherwise("long_names")


def characters(text: Column) -> Column:
    return F.filter(F.array_distinct(F.split(text, "")), lambda c: c != "")


def _jaccard(a: Column, b: Column) -> Column:
    both = F.size(F.array_intersect(a, b)).cast("double")
    return both / (F.size(a) + F.size(b) - both)


def character_likeness(a: Column, b: Column, chars_a: Column, chars_b: Column) -> Column:
    """1 for equal texts, 0 if either is empty, else the Jaccard likeness of their (given) character sets."""
    return F.when(a == b, 1.0).when((F.size(chars_a) == 0) | (F.size(chars_b) == 0), 0.0).otherwise(_jaccard(chars_a, chars_b))


def token_likeness(a: Column, b: Column) -> Column:
    """Jaccard likeness of two sets of tokens; 1 if both are empty."""
    return F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0).otherwise(_jaccard(a, b))


def code_tokens(code: Column) -> Column:
    """Identifiers, and what stands in quotes."""
    names = F.regexp_extract_all(code, F.lit(r"(?U)\b[a-zA-Z_]\w*\b"), 0)
    quoted = F.regexp_extract_all(code, F.lit("[\"']([^\"']*)[\"']"), 1)
    return F.array_union(names, quoted)


VERBS = sorted("validate check manage handle process compute calculate set get delete update create".split())


def intent_likeness(a: Column, b: Column, verbs: list[str] = VERBS) -> Column:
    """Jaccard likeness of the words of two statements, 0.3 more (at most 1) for the same verbs."""
    words = lambda x: F.array_distinct(F.regexp_extract_all(F.lower(x), F.lit(r"(?U)\w+"), 0))
    known = F.array(*[F.lit(v) for v in verbs])
    one, two = words(a), words(b)
    acts = lambda w: F.array_sort(F.array_intersect(w, known))
    bonus = F.when((F.size(acts(one)) > 0) & (acts(one) == acts(two)), 0.3).otherwise(0.0)
    return F.when((F.size(one) == 0) | (F.size(two) == 0), 0.0).otherwise(F.least(F.lit(1.0), _jaccard(one, two) + bonus))


def length_likeness(a: Column, b: Column) -> Column:
    return 1 - F.abs(F.length(a) - F.length(b)) / F.greatest(F.length(a), F.length(b), F.lit(1))


def hash_bits(feature: Column) -> Column:
    """The low 64 bits of a feature's MD5, as a signed number."""
    return F.conv(F.substring(F.md5(feature), 17, 16), 16, -10).cast("long")


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def hash_likeness(a: Column, b: Column, bits: int = 64) -> Column:
    return F.greatest(F.lit(0.0), 1 - hamming(a, b) / float(bits))


def title(key: Column) -> Column:
    return F.initcap(F.replace(key, F.lit("_"), F.lit(" ")))


def percent(x: Column) -> Column:
    return F.format_string("%.1f%%", x)


def ordinal(level: Column) -> Column:
    """high 3, medium 2, low 1, else 0."""
    return F.when(level == "high", 3).when(level == "medium", 2).when(level == "low", 1).otherwise(0)


def outer_json(response: Column) -> Column:
    """The outermost braces of a response."""
    return F.regexp_extract(response, r"(?s)\{.*\}", 0)


def occurrences(code: Column, part: str) -> Column:
    return ((F.length(code) - F.length(F.replace(code, F.lit(part), F.lit("")))) / len(part)).cast("int")


def shape_family(code: Column) -> Column:
    """A coarse family by the shape of the code."""
    lines = F.size(F.split(F.btrim(code), "\n", -1))
    returns = occurrences(code, "return")
    return (
        F.when((returns == 0) & (code.contains("self.") | code.contains("this.")), "state_modifiers")
        .when((returns == 1) & (lines < 5), "simple_accessors")
        .when(code.contains("for ") | code.contains("while "), "iterative_processors")
        .when(occurrences(code, "if ") > 2, "conditional_logic")
        .otherwise("general_functions")
    )


def _says(code: Column, *words: str) -> Column:
    return F.greatest(*[code.contains(w) for w in words], F.lit(False))


def structure_flags(code: Column, named: bool = False) -> Column:
    """Flags of a function's text, and the category that they suggest with its confidence and reasons.

    named: whether the function's name is known; names suggest nothing themselves, but lower the confidence to start from.
    """
    low = F.lower(code)
    lines = F.size(F.split(F.regexp_replace(code, r"(?U)^\s+|\s+$", ""), "\n", -1))
    state = code.contains("=") & ~code.contains("==")
    flow = _says(low, "for ", "while ", "if ", "elif ")
    is_async, handles = _says(low, "async def", "await "), _says(low, "try:", "except", "raise")
    logic = flow & (lines > 10)
    category = F.when(is_async, "async_handler").when(handles, "error_handler").when(logic, "business_logic").otherwise("unknown")
    confidence = F.when(is_async, 0.7).when(handles | logic, 0.6).otherwise(0.0 if named else 0.5)
    reasons = F.array_compact(F.array(F.when(is_async, "async operations detected"), F.when(handles, "error handling present"), F.when(logic, "complex business logic")))
    reasoning = F.when(F.size(reasons) > 0, F.array_join(reasons, "; ")).otherwise("Basic structural analysis")
    return F.struct(
        lines.alias("line_count"), code.contains("return ").alias("has_return_value"), state.alias("has_state_change"), flow.alias("has_control_flow"),
        is_async.alias("has_async"), handles.alias("has_error_handling"), category.alias("category"), confidence.alias("confidence"), reasoning.alias("reasoning"),
    )


def name_taxonomy(name: Column) -> Column:
    """What a name alone says of a function's category: nothing, for any name."""
    return F.struct(F.lit("unknown").alias("category"), F.lit(0.3).alias("confidence"), F.array(F.lit("no clear naming pattern")).alias("indicators"))


#: Families of names in order of precedence; each is a pattern from the start of a name.
FAMILIES = [
    *[(family, f"(?:{'|'.join(words.split())})_") for family, words in (
        ("data_accessors", "read load retrieve fetch get"), ("data_mutators", "store save write modify update set"), ("state_checkers", "must should can has is"),
        ("validators", "assert ensure verify check validate"), ("processors", "perform run execute process handle"), ("transformers", "serialize format parse transform convert"),
        ("factories", "setup initialize construct make build create"), ("calculators", "analyze derive compute calculate"),
    )],
    ("utilities", "_(?:helper|util|utility)$"), ("event_handlers", "on_|handle_.*_event|.*_(?:listener|handler)$"), ("test_functions", "test_|assert_|verify_.*_test"), ("special_methods", "__.*__$"),
]


def pattern_family(name: Column, code: Column) -> Column:
    """The first family whose pattern fits the start of a name whatever its case, else the family of the code's shape."""
    out = shape_family(code)
    for family, pattern in reversed(FAMILIES):
        out = F.when(name.rlike(f"(?i)^(?:{pattern})"), F.lit(family)).otherwise(out)
    return out


GROUP_PREFIXES = [f"{x}_" for x in sorted("check validate should can has is set get".split())]


def group_likeness(name_a: Column, name_b: Column, code_a: Column, code_b: Column) -> Column:
    """Likeness within a group: 1 for one skeleton, 0.85 for the same known prefix, else 0.7 of the ratio of lengths."""
    same = F.greatest(*[F.lower(name_a).startswith(p) & F.lower(name_b).startswith(p) for p in GROUP_PREFIXES])
    longer = F.greatest(F.length(code_a), F.length(code_b))
    ratio = F.when(longer > 0, F.least(F.length(code_a), F.length(code_b)) / longer).otherwise(1.0)
    return F.when(skeleton(code_a) == skeleton(code_b), 1.0).when(same, 0.85).otherwise(F.least(ratio * 0.7, F.lit(0.95)))


def common_start(a: Column, b: Column) -> Column:
    """The longest common start of two texts (of a set of texts: of its least and its greatest)."""
    most = F.least(F.length(a), F.length(b))
    fits = F.filter(F.sequence(F.lit(0), most), lambda n: F.substring(a, F.lit(1), n) == F.substring(b, F.lit(1), n))
    return F.substring(a, F.lit(1), F.array_max(fits))


def cluster_label(least: Column, most: Column, least_end: Column, most_end: Column, family: Column) -> Column:
    """A label by the names' common start or end, of more than 3 characters, else by the family.

    least, most: the least and greatest name; least_end, most_end: of the reversed names.
    """
    start, end = common_start(least, most), F.reverse(common_start(least_end, most_end))
    return F.when(F.length(start) > 3, F.concat(start, F.lit("* functions"))).when(F.length(end) > 3, F.concat(F.lit("*"), end, F.lit(" functions"))).otherwise(title(family))


def cut(code: Column, most: int = 500) -> Column:
    return F.substring(code, 1, most)


def iso(time: Column) -> Column:
    """A timestamp in ISO form, with microseconds where there are any."""
    whole = F.date_format(time, "yyyy-MM-dd'T'HH:mm:ss")
    micro = F.date_format(time, "SSSSSS")
    return F.when(micro != "000000", F.concat(whole, F.lit("."), micro)).otherwise(whole)


def from_iso(text: Column) -> Column:
    return F.try_to_timestamp(text)


def within(path: Column, root: str) -> Column:
    """Whether a normal path is a folder or below it."""
    root = root.rstrip("/")
    return (path == (root or "/")) | path.startswith(root + "/")


def relative(path: Column, root: str) -> Column:
    """A path below a folder from there on; others, and the folder itself as ".", whole."""
    root = root.rstrip("/")
    return F.when(path == root, ".").when(within(path, root), F.substring(path, len(root) + 2, 1 << 30)).otherwise(path)


LIFECYCLE = [f"{a}{b}" for a in ("setup", "teardown") for b in ("", "_module", "_class", "_method", "_function")]
LIFECYCLE += [f"{a}{b}" for a in ("setUp", "tearDown") for b in ("", "Class", "Module")]
LIFECYCLE += [f"assert_{x}" for x in ("not_in", "in", "raises", "false", "true", "equal")]


def is_test_name(name: Column) -> Column:
    return name.rlike(r"^test_|^test\p{Lu}") | name.isin(LIFECYCLE)


def is_test_path(path: Column) -> Column:
    parts = F.split(F.lower(path), "/")
    folders = F.array(*[F.lit(x) for x in ("test", "tests", "testing", "__test__", "__tests__")])
    last = F.element_at(parts, -1)
    return F.arrays_overlap(parts, folders) | last.startswith("test_") | last.endswith("_test.py") | (last.contains("test") & last.endswith(".py"))
