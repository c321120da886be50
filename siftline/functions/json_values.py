"""JSON values as VARIANT columns: strict parsing, type tags, paths, quoting and trimming."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space in the Unicode sense, as a character class of Java regular expressions.
SPACE = r"[\t-\r \u0085\p{Z}]"
#: The same characters one by one.
SPACES = "\t\n\x0b\x0c\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
_MARK = "siftline-end-of-line-7f1c"


def allow_duplicate_keys(spark: SparkSession) -> None:
    """Duplicate keys of an object are legal and the last one wins."""
    spark.conf.set("spark.sql.variant.allowDuplicateKeys", "true")


def trim(text: Column) -> Column:
    """text, a column, without white space at its ends; only what is not UTF-8 is searched whole, by characters as Java decodes it."""
    return F.when(F.is_valid_utf8(text), F.btrim(text, F.lit(SPACES))).otherwise(F.regexp_replace(text, f"^{SPACE}+|{SPACE}+$", ""))


def with_document(lines: DataFrame, line: str = "line") -> DataFrame:
    """lines with doc (VARIANT), tag and valid: whether the whole line is one JSON value.

    The parser stops after a first value, so the line is wrapped in an array with a mark behind it: two members with the
    mark as the second mean exactly one value. A number beyond a double's range is not valid.
    """
    wrapped = F.try_parse_json(F.concat(F.lit("["), F.col(line), F.lit(f',"{_MARK}"]'))).cast("array<variant>")
    parsed = once(lines, _parts=wrapped)
    one = F.coalesce((F.size("_parts") == 2) & (F.expr("try_variant_get(_parts[1], '$', 'string')") == _MARK), F.lit(False))
    parsed = once(parsed, doc=F.when(one, F.expr("_parts[0]"))).drop("_parts")
    endless = F.col(line).rlike(r"[eE]\+?\d{3,}|\d{309,}") & F.to_json(F.struct("doc")).rlike(r'[:\[,]"?-?Infinity')
    valid = F.col("doc").isNotNull() & ~F.coalesce(endless, F.lit(False))
    parsed = tagged(once(parsed, valid=valid))
    return parsed.withColumn("tag", F.when(F.col("valid"), F.col("tag")))


def tagged(docs: DataFrame) -> DataFrame:
    """docs with the tag of doc, whose type is looked up once a row."""
    return once(docs, _kind=F.schema_of_variant("doc")).withColumn("tag", _tag(F.col("_kind"))).drop("_kind")


def once(df: DataFrame, **columns: Column) -> DataFrame:
    """df with more columns, each worked out once a row: what filters and later columns use is the value, not its expression again."""
    made = F.explode(F.array(F.struct(*(c.alias(name) for name, c in columns.items())))).alias("_once")
    return df.select("*", made).select(*(F.col(f"`{c}`") for c in df.columns if c not in columns), *(F.col(f"_once.{name}").alias(name) for name in columns))


def tag(value: Column) -> Column:
    """null, boolean, number, string, array or object; SQL NULL for a missing value."""
    return _tag(F.schema_of_variant(value))


def is_string(value: Column) -> Column:
    """Whether tag has string; the type is looked up once."""
    return F.schema_of_variant(value) == "STRING"


def _tag(kind: Column) -> Column:
    return (
        F.when(kind == "VOID", "null").when(kind == "BOOLEAN", "boolean").when(kind == "STRING", "string")
        .when(kind.startswith("ARRAY"), "array").when(kind.startswith("OBJECT"), "object").when(kind.isNotNull(), "number")
    )


def member_of(value: Column, name: str) -> Column:
    """The member of an object, as VARIANT; SQL NULL if it is missing or the value is no object. Paths have no way to escape quotes."""
    quote = next((q for q in "\"'" if q not in name), None) if name else None
    if quote is None:
        return F.try_element_at(F.try_variant_get(value, "$", "map<string,variant>"), F.lit(name))
    return F.try_variant_get(value, f"$[{quote}{name}{quote}]", "variant")


def member(value: str, name: str) -> Column:
    """As member_of, for a column by its name."""
    return member_of(F.col(value), name)


def text_of(value: Column) -> Column:
    """The string of a VARIANT that is one, else SQL NULL: numbers are not turned to text."""
    return F.when(is_string(value), F.try_variant_get(value, "$", "string"))


def items_of(value: Column) -> Column:
    """The elements of a VARIANT that is an array, else SQL NULL."""
    return F.try_variant_get(value, "$", "array<variant>")


def quoted(text: Column) -> Column:
    """text in double quotes with backslashes, quotes and the common control characters escaped."""
    out = text
    for plain, escaped in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\t", "\\t"), ("\r", "\\r")):
        out = F.replace(out, F.lit(plain), F.lit(escaped))
    return F.concat(F.lit('"'), out, F.lit('"'))


def rounded(value: Column, digits: int) -> Column:
    """A number as text with half-even rounding, as C's printf has it."""
    return F.format_string(f"%.{digits}f", F.bround(value, digits))


def entries(docs: DataFrame) -> DataFrame:
    """(path, row, key, value) of the top-level members of docs that are objects."""
    objects = docs.where("tag = 'object'").select("path", "row", "doc")
    return docs.sparkSession.sql("SELECT path, row, e.key, e.value FROM {objects}, LATERAL variant_explode(doc) AS e", objects=objects)


@dataclass(frozen=True)
class Step:
    """One step of a declared path: into a member, or into the elements of an array."""

    name: str | None


def parse_path(path: str) -> list[Step]:
    """a.b, a[] and a[].b; an empty path or an empty part is not valid."""
    steps: list[Step] = []
    for part in path.split("."):
        arrays = 0
        while part.endswith("[]"):
            part, arrays = part[:-2], arrays + 1
        if not part:
            return []
        steps += [Step(part), *[Step(None)] * arrays]
    return steps


@dataclass
class PathTree:
    """Declared paths by their common beginnings: the paths that end here, and what lies below a member or an element."""

    ends: list[str]
    below: dict[Step, PathTree]

    @classmethod
    def of(cls, paths: list[str]) -> PathTree:
        """Paths that are not valid are left out."""
        root = cls([], {})
        for path in paths:
            at = root
            for step in parse_path(path):
                at = at.below.setdefault(step, cls([], {}))
            if at is not root:
                at.ends.append(path)
        return root


def kinds_at(value: Column, tree: PathTree) -> Column:
    """array<struct<at,kind>>: the type of every value at the tree's paths, found in one walk of a VARIANT.

    A wrong shape or a missing member ends the walk there. Paths share their common steps, so each value is taken out once.
    """
    def walk(below: PathTree):
        return lambda v: kinds_at(v, below)

    none = F.array().cast("array<struct<at:string,kind:string>>")
    found = [F.transform(F.array(*map(F.lit, tree.ends)), lambda at: F.struct(at.alias("at"), tag(value).alias("kind")))] if tree.ends else []
    members = [(s.name, t) for s, t in tree.below.items() if s.name is not None]
    for name, below in members:
        inner = F.filter(F.array(member_of(value, name)), lambda v: v.isNotNull())  # null if value is no object
        found.append(F.flatten(F.transform(inner, walk(below))))
    for below in (t for s, t in tree.below.items() if s.name is None):
        found.append(F.coalesce(F.flatten(F.transform(items_of(value), walk(below))), none))
    return F.concat(*found) if found else none
