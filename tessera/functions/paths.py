"""Path predicates and the file selection cascade as column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# What paths and names mean.
TEST_DIRS = ("test", "tests", "__tests__", "testdata", "testutil")
TEST_SUFFIXES = ("_test.go", "_test.py", "_test.ts", "_test.js", "_spec.rb", "Test.java", "Tests.java", "Test.cs", "Tests.cs")
SCRIPT_EXTENSIONS = ("ts", "tsx", "js", "jsx", "mjs", "cjs", "mts", "cts")
DOC_DIRS = ("doc", "docs", "documentation")
DOC_EXTENSIONS = ("md", "markdown", "rst", "adoc", "asciidoc")
DOC_STEMS = ("readme", "changelog", "license", "licence", "contributing", "notice", "authors")
VENDORED_DIRS = ("node_modules", "vendor", "third_party", "thirdparty", ".venv", "site-packages")
GENERATED_DIRS = ("dist", "build", "target", "out", ".next", "generated", "__generated__", "__snapshots__", "coverage", ".idea", ".gradle", ".nx", ".angular")
CATALOGUE_DIRS = ("i18n", "locales", "locale", "translations")
CATALOGUE_EXTENSIONS = ("json", "xml", "yaml", "yml", "properties", "xlf", "xliff", "po", "pot", "resx", "strings", "csv", "arb")
LOCK_FILES = ("package-lock.json", "pnpm-lock.yaml")
GENERATED_SUFFIXES = (".pb.go", ".pb.ts", ".pb.js", "_pb2.py", "_pb2_grpc.py", ".g.dart", ".freezed.dart", ".gen.go", ".gen.ts", ".designer.cs")
DATA_EXTENSIONS = ("csv", "tsv", "jsonl", "ndjson", "geojson", "parquet", "avro", "map", "snap", "har", "log", "xlf", "xliff", "po", "pot", "mo", "resx", "strings", "svg", "pdf", "ipynb", "translation")
SIZED_DATA_EXTENSIONS = ("json", "json5", "xml", "plist")
SCHEMA_EXTENSIONS = ("xsd", "wsdl")
MANIFESTS = ("project.json", "package.json", "nx.json", "angular.json", "pom.xml", "composer.json", "deno.json", ".eslintrc.json", "renovate.json", "applicationContext.xml", "persistence.xml", "web.xml", "logback.xml", "logback-spring.xml", "log4j2.xml", "appsettings.json", "launchSettings.json")
CONFIG_EXTENSIONS = ("properties", "yaml", "yml", "conf", "env", "toml", "ini", "json", "tfvars", "cfg", "xml", "config")
LANGUAGES = {
    "java": "java", "go": "go", "ts": "ts", "tsx": "tsx", "js": "js", "jsx": "jsx", "py": "py", "rb": "rb", "cs": "cs", "kt": "kt", "scala": "scala", "rs": "rs", "c": "c", "h": "c", "cc": "cpp", "cpp": "cpp", "hpp": "cpp",
    "php": "php", "sh": "sh", "sql": "sql", "md": "md", "yaml": "yaml", "yml": "yaml", "json": "json", "xml": "xml", "properties": "properties", "html": "html", "css": "css", "scss": "scss", "bpmn": "bpmn", "xsd": "xsd", "wsdl": "wsdl", "mtxm": "mtext", "mtxt": "mtext",
}
#: Credentials wherever they stand, in the order in which they are tried.
SECRET_SHAPES = (
    "AKIA[0-9A-Z]{16}", "-----BEGIN [A-Z ]*PRIVATE KEY-----", "gh[pousr]_[A-Za-z0-9]{36,}", "github_pat_[A-Za-z0-9_]{22,}", r"glpat-[A-Za-z0-9\-_]{20,}", r"xox[baprs]-[A-Za-z0-9\-]{10,}", "sk-[A-Za-z0-9]{32,}", r"(?i)aws_secret_access_key\s*[=:]\s*\S{20,}",
)
GENERATED_MARK = r"(?i)code generated .{0,60}do not edit|(?:^|[\s/*#])@generated\b|<auto-generated"
MOST_BYTES, MOST_DATA_BYTES, MOST_SCHEMA_BYTES = 1 << 20, 8 << 10, 256 << 10


def base(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)$", 1)


def directory(path: Column) -> Column:
    """the directory, "." at the top."""
    d = F.regexp_extract(path, r"^(.*)/[^/]*$", 1)
    return F.when(d == "", ".").otherwise(d)


def extension(path: Column) -> Column:
    """lower-cased, without the dot; empty if there is none."""
    return F.lower(F.regexp_extract(base(path), r"\.([^.]*)$", 1))


def depth(path: Column) -> Column:
    return F.size(F.split(path, "/")) - 1


def _any(values: tuple[str, ...]) -> str:
    return "|".join(re.sub(r"([^\w\s])", r"\\\1", v) for v in values)


def like(path: Column, pattern: str) -> Column:
    return F.regexp_like(path, F.lit(pattern))


TEST_PATTERN = rf"(?:^|/)(?i:{_any(TEST_DIRS)})/|(?:{_any(TEST_SUFFIXES)})$|(?:^|/)test_[^/]*$|\.(?:test|spec)\.(?:{_any(SCRIPT_EXTENSIONS)})$"
DOC_PATTERN = rf"(?i)(?:^|/)(?:{_any(DOC_DIRS)})/|\.(?:{_any(DOC_EXTENSIONS)})$|(?:^|/)(?:{_any(DOC_STEMS)})(?:\.txt)?$"
VENDORED_PATTERN = rf"(?:^|/)(?:{_any(VENDORED_DIRS)})(?:/|$)"
GENERATED_PATTERN = rf"(?:^|/)(?:{_any(LOCK_FILES)})$|(?i:\.(?:lock|sum|min\.js|min\.css)$)|(?:^|/)(?:{_any(GENERATED_DIRS)})(?:/|$)|(?:^|/)(?:{_any(CATALOGUE_DIRS)})/(?:.*/)?[^/]*\.(?i:{_any(CATALOGUE_EXTENSIONS)})$|(?i:(?:^|[-_./])generated(?:[-_.][^/]*)?$)|(?i:(?:{_any(GENERATED_SUFFIXES)})$)"


def is_test(path: Column) -> Column:
    """P06."""
    return like(path, TEST_PATTERN)


def is_doc(path: Column) -> Column:
    """P07."""
    return like(path, DOC_PATTERN)


def kind_rank(path: Column) -> Column:
    """0 code, 1 test, 2 document; a document in a test directory is a document."""
    return F.when(is_doc(path), 2).when(is_test(path), 1).otherwise(0)


def glob_pattern(glob: str) -> str:
    """`*` and `?` within a segment, `**` for any number of whole segments."""
    parts = glob.split("/")
    out = ""
    for i, part in enumerate(parts):
        last = i == len(parts) - 1
        if part == "**":
            out += ".*" if last else "(?:[^/]+/)*"
        else:
            out += "".join("[^/]*" if c == "*" else "[^/]" if c == "?" else re.sub(r"([^\w])", r"\\\1", c) for c in part) + ("" if last else "/")
    return f"^{out}$"


def matches_glob(path: Column, *globs: str) -> Column:
    found = F.lit(False)
    for g in globs:
        found = found | like(path, glob_pattern(g))
    return found


def language(path: Column) -> Column:
    """Empty if unknown."""
    known = F.create_map(*[F.lit(x) for pair in LANGUAGES.items() for x in pair])
    return F.coalesce(F.try_element_at(known, extension(path)), F.lit(""))


def is_config(path: Column) -> Column:
    return extension(path).isin(*CONFIG_EXTENSIONS) | like(base(path), r"(?i)^(?:\.env(?:\..*)?|\.npmrc)$")


def is_manifest(path: Column) -> Column:
    name = base(path)
    return name.isin(*MANIFESTS) | like(name, r"(?i)^(?:tsconfig|appsettings\.).*\.json$|\.bpmn20\.xml$|\.bpmn\.xml$")


def is_script(path: Column) -> Column:
    """Ts, tsx, js, jsx and mts files."""
    return like(path, r"\.(?:tsx?|jsx?|mts)$")


def skip_by_path(path: Column, exclude: tuple[str, ...] = ()) -> Column:
    """P10: why a path alone is skipped: excluded, vendored or generated; null if it is not."""
    return F.when(matches_glob(path, *exclude), "excluded").when(like(path, VENDORED_PATTERN), "vendored").when(like(path, GENERATED_PATTERN), "generated")


def skip_by_data(path: Column, size: Column) -> Column:
    """Data formats, and the ceilings of data and schema formats."""
    ext = extension(path)
    data = ext.isin(*DATA_EXTENSIONS) | (ext.isin(*SCHEMA_EXTENSIONS) & (size > MOST_SCHEMA_BYTES)) | (ext.isin(*SIZED_DATA_EXTENSIONS) & (size > MOST_DATA_BYTES) & ~is_manifest(path))
    return F.when(data, "data")


def skip_by_size(path: Column, size: Column, exclude: tuple[str, ...] = ()) -> Column:
    """P11 before a body is read: a configuration file's data ceiling waits for its redacted size."""
    known = F.when(is_config(path), F.lit(0)).otherwise(size)
    return F.when(size > MOST_BYTES, "too_large").otherwise(F.coalesce(skip_by_path(path, exclude), skip_by_data(path, known)))


def secret_shape(body: Column) -> Column:
    """The first credential pattern that the body matches, null if none."""
    out = F.when(F.lit(False), F.lit(""))
    for p in SECRET_SHAPES:
        out = out.when(like(body, p), p)
    return out


def secret_manifest(path: Column, body: Column) -> Column:
    return like(path, r"(?i)\.ya?ml$") & like(body, r"(?m)^kind:[ \t]*[\"']?(?:Secret|SealedSecret)[\"']?[ \t]*\r?$")


def skip_by_body(path: Column, body: Column, exclude: tuple[str, ...] = ()) -> Column:
    """The whole cascade over a (redacted) body."""
    size = F.octet_length(body)
    return (
        F.when(size > MOST_BYTES, "too_large")
        .when(F.contains(body, F.lit("\u0000")), "binary")
        .when(secret_manifest(path, body) | secret_shape(body).isNotNull(), "secret")
        .otherwise(F.coalesce(skip_by_path(path, exclude), skip_by_data(path, size), F.when(like(F.left(body, F.lit(2048)), GENERATED_MARK), "generated"), F.lit("")))
    )


def stage_scope(repo: Column, path: Column, prefixes: Column) -> Column:
    """`prefixes` is the repository's prefix for the stage (null: it declares no stages)."""
    return prefixes.isNull() | F.startswith(path, prefixes)
