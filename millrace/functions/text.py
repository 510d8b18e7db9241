"""Texts of changes: messages, code lines, paths and unified diffs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fixed values, which results depend on: line separators of Unicode text; file
#: suffixes by the way comments are written; lock files; characters that stand
#: alone as tokens; commit ids, full or shortened; repositories as owner/name.
LINE_BREAK = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"
SLASH_COMMENT = (".c", ".cc", ".cpp", ".cs", ".cxx", ".dart", ".go", ".groovy", ".h", ".hpp", ".java", ".js", ".jsx", ".kt", ".kts", ".m", ".mm", ".php", ".rs", ".scala", ".swift", ".ts", ".tsx")
HASH_COMMENT = (".bash", ".pl", ".py", ".r", ".rb", ".sh")
LOCK_FILE = r"(^|/)(package-lock\.json|yarn\.lock|pnpm-lock\.yaml|Gemfile\.lock|poetry\.lock|Cargo\.lock|go\.sum)$"
ALONE = r"([.,;:(){}\[\]+\-*/=<>&|?@%^~\\])"
COMMIT_ID, REPOSITORY = r"^[0-9a-fA-F]{7,64}$", r"^[A-Za-z0-9_.-]+/[A-Za-z0-9_.-]+$"


def squeeze(text: Column) -> Column:
    """Runs of white space as one space, none at the ends."""
    return F.trim(F.regexp_replace(text, r"(?U)[\s\x1c-\x1f]+", " "))


def tokenize(text: Column) -> Column:
    """Underscores as spaces, punctuation set apart, single spaces."""
    return squeeze(F.regexp_replace(F.replace(text, F.lit("_"), F.lit(" ")), ALONE, r" $1 "))


def clean_message(text: Column) -> Column:
    """A commit message without import trailers, as tokens."""
    return tokenize(F.array_join(F.filter(F.split(text, "\n"), lambda x: ~x.startswith("git-svn-id:")), "\n"))


def cut_comment(line: Column, marker: str) -> Column:
    """The line up to a comment marker outside of string literals.  A backslash
    escapes inside a literal; a literal left open takes the rest."""
    first = marker[0]
    other = f"{first}(?!{marker[1:]})|" if len(marker) > 1 else ""
    pattern = rf"""^((?:[^"'{first}]++|{other}"(?:[^"\\]++|\\.)*+(?:"|\\?$)|'(?:[^'\\]++|\\.)*+(?:'|\\?$))*+)"""
    return F.regexp_extract(line, pattern, 1)


def clean_line(line: Column, extension: Column) -> Column:
    """A code line as tokens without comments, by the language of its file; a
    line that is all comment gives an empty text."""
    s = F.btrim(line)
    slash, hashed = extension.isin(*SLASH_COMMENT), extension.isin(*HASH_COMMENT)
    return (
        F.when(slash & s.rlike(r"^(//|/\*|\*)"), "").when(slash, tokenize(cut_comment(s, "//")))
        .when(hashed & s.startswith("#"), "").when(hashed, tokenize(cut_comment(s, "#"))).otherwise(tokenize(s))
    )


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def extension(path: Column) -> Column:
    """The lower-case suffix of a file name with its dot; names that only begin
    or end with a dot have none."""
    return F.lower(F.regexp_extract(basename(path), r"^.+(\.[^.]+)$", 1))


def subsystem(path: Column) -> Column:
    """The first directory; empty at the root."""
    return F.when(path.contains("/"), F.substring_index(path, "/", 1)).otherwise("")


def directory(path: Column) -> Column:
    return F.regexp_extract(path, r"^(.*)/[^/]*$", 1)


def renamed_to(path: Column) -> Column:
    """The new path of a rename as listed by numstat."""
    braces = F.replace(F.regexp_replace(path, r"^(.*)\{(.*) => (.*)\}(.*)$", "$1$3$4"), F.lit("//"), F.lit("/"))
    return F.when(path.rlike(r"\{.* => .*\}"), braces).when(path.contains(" => "), F.regexp_extract(path, r"(?s)^.*? => (.*)$", 1)).otherwise(path)


def says_fix(message: Column) -> Column:
    return F.coalesce(message.rlike("(?i)fix|bug"), F.lit(False))


def is_commit_hash(x: Column) -> Column:
    return F.coalesce(x.rlike(COMMIT_ID), F.lit(False))


def is_repository(x: Column) -> Column:
    """owner/name without parts that are only dots."""
    return F.coalesce(x.rlike(REPOSITORY) & ~x.rlike(r"(^|/)\.{1,2}(/|$)"), F.lit(False))


def binary_label(x: Column) -> Column:
    """1 or 0 for the usual spellings; anything else is null, never 0."""
    s = F.lower(F.btrim(x.cast("string")))
    return F.when(s.isin("1", "true", "1.0"), 1).when(s.isin("0", "false", "0.0"), 0)


def lines(text: Column) -> Column:
    """Lines at any separator of Unicode; a last separator opens no line."""
    parts = F.split(text, LINE_BREAK)
    return F.when(text == "", F.array().cast("array<string>")).when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)


def normalize_patch(diff: Column) -> Column:
    """A diff without what varies between equal patches: blob ids and positions
    of hunks, trailing space and surrounding blank lines."""
    kept = F.filter(lines(diff), lambda x: ~x.startswith("index "))
    tidy = F.transform(kept, lambda x: F.regexp_replace(F.regexp_replace(x, r"^@@.*?@@", "@@"), r"(?U)\s+$", ""))
    return F.regexp_replace(F.array_join(tidy, "\n"), r"(?U)^\s+|\s+$", "")


def patch_key(diff: Column) -> Column:
    """A digest of the changed lines without white space; null without any."""
    body = F.filter(lines(diff), lambda x: x.rlike(r"^[+-]") & ~x.rlike(r"^(\+\+\+|---)"))
    return content_key(F.transform(body, lambda x: F.substring(x, 2, 1 << 30)))


def content_key(changed: Column) -> Column:
    """A digest of an array of changed lines without white space; null if all are blank."""
    bare = F.filter(F.transform(changed, lambda x: F.regexp_replace(x, r"(?U)[\s\x1c-\x1f]+", "")), lambda x: x != "")
    return F.when(F.size(bare) > 0, F.sha2(F.array_join(bare, "\n"), 256))


def message_key(message: Column, least: int = 20) -> Column:
    """A digest of a message without case and layout; null for short ones."""
    m = squeeze(F.lower(message))
    return F.when(F.length(m) >= least, F.sha2(m, 256))


def file_sections(diff: Column) -> Column:
    """The sections of a diff, one per file, each with its header line."""
    return F.filter(F.split(diff, r"(?m)^(?=diff --git )"), lambda x: x.startswith("diff --git "))


def header_path(line: Column) -> Column:
    """The path that a file header names: the one it repeats, which may hold
    blanks, or else the new one, without its prefix and quotes."""
    first = F.regexp_extract(line, r"^diff --git a/(.+) b/\1$", 1)
    new = F.regexp_extract(line, r'^diff --git .* "?(?:[ab]/)?([^" ]+|(?<=b/).+?)"?$', 1)
    return F.when(first != "", first).when(new != "", new).otherwise(F.regexp_extract(line, r"^diff --git (?:[ab]/)?(.*)$", 1))


def clean_diff(diff: Column) -> Column:
    """Struct of text, kept, skipped_binary, skipped_lock, hunks: the diff without
    the sections of binary and lock files, and the number of each kind."""

    def sort_out(section: Column) -> Column:
        kind = F.when(section.contains("\nBinary files ") | section.contains("GIT binary patch"), "binary").when(header_path(F.substring_index(section, "\n", 1)).rlike(LOCK_FILE), "lock")
        return F.struct(F.coalesce(kind, F.lit("code")).alias("kind"), F.regexp_replace(section, r"\n+$", "").alias("body"))

    sections = F.transform(file_sections(diff), sort_out)
    of = lambda kind: F.filter(sections, lambda x: x["kind"] == kind)
    code = F.transform(of("code"), lambda x: x["body"])
    hunks = F.aggregate(code, F.lit(0), lambda n, x: n + F.regexp_count(x, F.lit(r"\n@@ ")))
    return F.struct(F.array_join(code, "\n").alias("text"), F.size(code).alias("kept"), F.size(of("binary")).alias("skipped_binary"), F.size(of("lock")).alias("skipped_lock"), hunks.alias("hunks"))


def hunk_units(diff: Column) -> Column:
    """Units of a diff that can be dropped whole: a file header with its first
    hunk, then every further hunk."""

    def units(section: Column) -> Column:
        pieces = F.split(section, r"(?m)^(?=@@ )")
        few = F.array(section)
        many = F.concat(F.array(F.concat(F.element_at(pieces, 1), F.get(pieces, F.lit(1)))), F.slice(pieces, 3, F.greatest(F.size(pieces) - 2, F.lit(0))))
        return F.when(F.size(pieces) <= 2, few).otherwise(many)

    return F.transform(F.flatten(F.transform(file_sections(diff), units)), lambda x: F.regexp_replace(x, r"\n+$", ""))


def render(message: Column, added: Column, deleted: Column) -> Column:
    """Message, then added and deleted lines with their signs; without lines the
    message alone, and without a message the lines alone."""
    code = F.concat(F.transform(added, lambda x: F.concat(F.lit("+ "), x)), F.transform(deleted, lambda x: F.concat(F.lit("- "), x)))
    head = F.when(F.coalesce(message, F.lit("")) != "", F.array(message)).otherwise(F.array().cast("array<string>"))
    return F.array_join(F.concat(head, code), "\n")


def head_tail(ids: Column, budget: int, marker: list[int]) -> Column:
    """Ids cut to a budget: the larger half from the head, a marker, the rest
    from the tail; without room for a marker the head alone."""
    mark = F.array(*[F.lit(m) for m in marker]).cast("array<int>")
    if budget < len(marker) + 2:
        return F.slice(ids, 1, max(0, budget))
    body = budget - len(marker)
    head, tail = (body + 1) // 2, body - (body + 1) // 2
    ends = F.concat(F.slice(ids, 1, head), mark, F.slice(ids, -tail, tail)) if tail else F.concat(F.slice(ids, 1, head), mark)
    return F.when(F.size(ids) <= budget, ids).otherwise(ends)


def messages(system: Column, demos: Column, user: Column) -> Column:
    """Chat messages: the system text, pairs of demos (structs of user and
    assistant), and the user's."""
    one = lambda role, c: F.struct(F.lit(role).alias("role"), c.alias("content"))
    pairs = F.flatten(F.transform(demos, lambda x: F.array(one("user", x["user"]), one("assistant", x["assistant"]))))
    return F.concat(F.array(one("system", system)), pairs, F.array(one("user", user)))


def parse_score(reply: Column, key: str = "risk_score") -> Column:
    """The score of a reply that is a JSON object of exactly one key with a number
    from 0 to 100, as a fraction; else null.  A code fence may stand around it,
    alone on its line, unmarked or marked json."""
    body = F.btrim(F.regexp_replace(F.btrim(reply), r"(?s)^```(?:json)?\n(.*)```$", "$1"))
    number = F.regexp_extract(body, rf'^\{{\s*"\Q{key}\E"\s*:\s*(-?\d+(?:\.\d+)?(?:[eE][+-]?\d+)?)\s*\}}$', 1)
    x = number.try_cast("double")
    return F.when(x.between(0, 100), x / 100)


def patch_statistics(df: DataFrame, identity: str, diff: str) -> DataFrame:
    """(identity, added, deleted, files, directories, entropy, binary, hunks) of
    unified diffs; entropy is in bits over the changed lines of the files.

    Lines count inside hunks only, so header lines never do.  Changed lines
    before any file header belong to a file of their own at the root.
    """
    rows = df.select(identity, F.posexplode_outer(lines(F.replace(F.col(diff), F.lit("\r\n"), F.lit("\n")))).alias("pos", "line"))
    w = Window.partitionBy(identity).orderBy("pos")
    line = F.coalesce("line", F.lit(""))
    start, hunk, binary = line.startswith("diff --git "), line.startswith("@@"), line.startswith("Binary files ") | line.startswith("GIT binary patch")
    rows = rows.select(identity, line.alias("line"), start.alias("start"), hunk.alias("hunk"), binary.alias("bin"), F.sum(start.cast("int")).over(w).alias("file"), F.coalesce(F.last(F.when(hunk, True).when(start | binary, False), True).over(w), F.lit(False)).alias("inside"))
    plus, minus = F.col("inside") & ~F.col("hunk") & F.col("line").startswith("+"), F.col("inside") & ~F.col("hunk") & F.col("line").startswith("-")
    path = header_path(F.col("line"))
    files = rows.groupBy(identity, "file").agg(F.count_if(plus).alias("a"), F.count_if(minus).alias("d"), F.count_if("bin").alias("b"), F.count_if("hunk").alias("h"), F.max(F.when(F.col("start"), directory(path))).alias("dir"))
    real = (F.col("file") > 0) | (F.col("a") + F.col("d") > 0)
    churn = F.col("a") + F.col("d")
    total = F.sum(churn)
    logs = F.sum(F.when(churn > 0, churn * F.log2(churn.cast("double"))))
    return files.groupBy(identity).agg(
        F.sum("a").alias("added"), F.sum("d").alias("deleted"), F.count_if(real).alias("files"), F.count_distinct(F.when(real, F.coalesce("dir", F.lit("")))).alias("directories"),
        F.coalesce(F.log2(F.nullif(total, F.lit(0)).cast("double")) - logs / total, F.lit(0.0)).alias("entropy"), F.sum("b").alias("binary"), F.sum("h").alias("hunks"),
    )
