"""Scalar functions over text, names and paths, all as Catalyst expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that carry no meaning as tokens.
STOPWORDS = (
    "and", "or", "the", "a", "an", "of", "to", "in", "on", "for", "with",
    "but", "not", "is", "are", "was", "were", "be", "been", "being",
    "it", "its", "this", "that", "these", "those", "at", "by", "as",
    "from", "into", "onto", "than", "then", "so", "if", "no", "yes",
)


def tokenize(name: Column) -> Column:
    """Distinct lower-case tokens of an identifier, over two letters, without stopwords."""
    words = F.split(name, r"[_\-\s]+|(?<=[a-z0-9])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])")
    return F.array_distinct(F.filter(F.transform(words, F.lower), lambda w: (F.length(w) > 2) & ~w.isin(*STOPWORDS)))


def text_tokens(text: Column) -> Column:
    """Distinct tokens of the identifiers in a text that are whole words, so no parts of words with other letters."""
    words = F.regexp_extract_all(text, F.lit(r"(?<![\p{L}\p{N}_])[a-zA-Z_][a-zA-Z0-9_]{2,}(?![\p{L}\p{N}_])"), F.lit(0))
    return F.array_distinct(F.flatten(F.transform(words, tokenize)))


def confidence(score: Column) -> Column:
    return F.when(score >= 20, "high").when(score >= 10, "medium").otherwise("low")


def slugify(heading: Column, longest: int = 40) -> Column:
    """A slug: leading symbols beyond ASCII dropped, "(s)" as s, punctuation deleted, lower case, runs of other characters
    as one dash, cut at the last dash within ``longest``."""
    plain = F.regexp_replace(heading, r"^(?:[ \t\n\r]|[\p{S}&&[^\x00-\x7F]])+", "")
    plain = F.regexp_replace(F.replace(plain, F.lit("(s)"), F.lit("s")), r"""[().,;:!?"'`@#$%^&*+=<>{}\[\]\\|/~]""", "")
    plain = F.regexp_replace(F.regexp_replace(F.lower(plain), r"[^a-z0-9]+", "-"), r"^-+|-+$", "")
    cut = F.regexp_replace(F.regexp_replace(F.substring(plain, 1, longest), r"(?<=.)-[^-]*$", ""), r"^-+|-+$", "")
    return F.when(F.length(plain) > longest, cut).otherwise(plain)


def slug_to_name(slug: Column) -> Column:
    """Each part between dashes with a capital first letter, the rest lower."""
    return F.array_join(F.transform(F.split(slug, "-"), lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substr(w, F.lit(2))))), " ")


def purl(ecosystem: Column, name: Column) -> Column:
    """Package url with the name normalised: runs of - _ . as one dash, lower case."""
    return F.concat(F.lit("pkg:"), ecosystem, F.lit("/"), F.lower(F.regexp_replace(name, r"[-_.]+", "-")))


def requirement(line: Column) -> Column:
    """(name, spec) of a requirement line without its comment, extras and marker; null where the line is none."""
    bare = F.trim(F.regexp_replace(line, r"#.*$", ""))
    shape = r"^([A-Za-z0-9][A-Za-z0-9._-]*)(?:\[[^\]]*\])?\s*([=<>!~].*)?$"
    spec = F.trim(F.regexp_replace(F.regexp_extract(bare, shape, 2), ";.*$", ""))
    return F.when(bare.rlike(shape), F.struct(F.regexp_extract(bare, shape, 1).alias("name"), spec.alias("spec")))


def closing_references(text: Column) -> Column:
    """Issue numbers that a text says it closes, fixes or resolves."""
    found = F.regexp_extract_all(text, F.lit(r"(?i)(?:closes?|fix(?:es)?|resolves?)\s+#([0-9]+)"), F.lit(1))
    return F.transform(found, lambda n: n.cast("long"))


def label_kind(labels: Column) -> Column:
    """What a ticket's labels say it is: those that hold "bug" come before those that hold "feature" or "enhancement"."""
    low = F.transform(labels, F.lower)
    wish = F.exists(low, lambda x: x.contains("feature") | x.contains("enhancement"))
    return F.when(F.exists(low, lambda x: x.contains("bug")), "bug").when(wish, "feature_request")


def candidate_paths(classname: Column) -> Column:
    """Paths a dotted class may stand in, longest first."""
    parts = F.split(classname, r"\.")
    return F.transform(F.sequence(F.size(parts), F.lit(1), F.lit(-1)), lambda n: F.concat(F.array_join(F.slice(parts, F.lit(1), n), "/"), F.lit(".py")))


def path_suffixes(path: Column) -> Column:
    """The path and all its endings that start after a slash."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, k, F.size(parts)), "/"))


def base_of(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def suffix_of(path: Column) -> Column:
    """The last extension with its dot; a name that only begins with a dot has none."""
    return F.regexp_extract(base_of(path), r"^.+(\.[^.]+)$", 1)


#: Fixed values by which a file's role is told.
GENERATED = r"(\.g\.cs|\.designer\.cs|\.generated\.h)$"
GENERATED_FOLDERS = ("Generated", "Intermediate")
TEST_STEMS = r"^(test_|Test)|(_test|_tests|Tests|_props)$"
TEST_FOLDERS = ("tests", "test", "Tests", "Test")
CONFIG_SUFFIXES = (
    ".toml", ".yaml", ".yml", ".json", ".ini", ".config", ".cfg", ".csproj", ".sln", ".uplugin", ".uproject",
    ".rules", ".service", ".timer", ".template", ".patch", ".plist", ".spec",
)
CONFIG_NAMES = (".coveragerc", ".gitignore", ".gitattributes", ".editorconfig", "CMakeLists.txt", "Makefile")
DOCS_SUFFIXES, DOCS_NAMES, DOCS_FOLDERS = (".md", ".mdx", ".tla"), ("LICENSE", "LICENCE", "NOTICE", "AUTHORS", "CHANGELOG"), ("spec",)
#: Languages by extension.
LANGUAGES = {
    ".py": "python", ".cs": "csharp", ".ts": "typescript", ".tsx": "typescript", ".js": "javascript", ".jsx": "javascript",
    ".go": "go", ".rs": "rust", ".cpp": "cpp", ".cc": "cpp", ".cxx": "cpp", ".c": "cpp", ".h": "cpp", ".hpp": "cpp",
    ".md": "markdown", ".mdx": "markdown", ".yaml": "yaml", ".yml": "yaml", ".toml": "toml", ".json": "json",
    ".sh": "shell", ".bash": "shell", ".uasset": "unreal_asset", ".umap": "unreal_asset", ".uplugin": "unreal_project", ".uproject": "unreal_project",
}


def role_of(path: Column) -> Column:
    """generated, test, config, docs or source, the first that fits."""
    base, suffix = base_of(path), suffix_of(path)
    stem = F.when(suffix == "", base).otherwise(F.substr(base, F.lit(1), F.length(base) - F.length(suffix)))
    folders = F.slice(F.split(path, "/"), F.lit(1), F.size(F.split(path, "/")) - 1)
    inside = lambda names: F.arrays_overlap(folders, F.array(*map(F.lit, names)))
    config = suffix.isin(*CONFIG_SUFFIXES) | base.isin(*CONFIG_NAMES) | base.startswith(".env.") | (base == ".env")
    config = config | ((suffix == ".txt") & base.startswith("requirements")) | base.endswith("VERSION")
    return (
        F.when(base.rlike(GENERATED) | inside(GENERATED_FOLDERS), "generated")
        .when(stem.rlike(TEST_STEMS) | inside(TEST_FOLDERS), "test")
        .when(config, "config")
        .when(suffix.isin(*DOCS_SUFFIXES) | base.isin(*DOCS_NAMES) | inside(DOCS_FOLDERS), "docs")
        .otherwise("source")
    )


def language_of(path: Column) -> Column:
    known = F.create_map(*[F.lit(x) for pair in LANGUAGES.items() for x in pair])
    return F.coalesce(F.try_element_at(known, F.lower(suffix_of(path))), F.lit("unknown"))


def confidence_band(base: Column, boosts: Column, penalties: Column, uncertainty: float = 0.06) -> Column:
    """(score, low, high): boosts close a share of the gap to 1, penalties take a share of what is there; all within [0, 1]."""
    up = F.aggregate(boosts, base.cast("double"), lambda s, b: s + b * (1 - s))
    down = F.aggregate(penalties, up, lambda s, p: s * (1 - p))
    score = F.greatest(F.lit(0.0), F.least(F.lit(1.0), down))
    return F.struct(score.alias("score"), F.greatest(F.lit(0.0), score - uncertainty).alias("low"), F.least(F.lit(1.0), score + uncertainty).alias("high"))


def natural_id(*parts: Column) -> Column:
    """A deterministic 64-bit id of a key: the first 8 bytes of SHA-256 over its parts, NUL between them."""
    joined = F.concat_ws("\0", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])
    raw = F.conv(F.substring(F.sha2(joined, 256), 1, 16), 16, -10)
    return raw.cast("long")
