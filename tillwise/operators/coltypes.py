"""Column type detection: every test of every column in one aggregate, then one projection.

Order of tests per text column: identifier by name, date, number, boolean, else text.  Numbers
may turn out to be dates written as YYYYMMDD.  Whole columns are tested, not their first rows.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillwise.functions.exprs import col, edge_pattern, let, lookup, ratio
from tillwise.functions.vocab import (
    CASE_WORDS, DATE_PLACEHOLDERS, FALSE_WORDS, ID_WORDS, NUMBER_WORDS, TRUE_WORDS,
)

# Shares of readable values that decide a type (fixed values)
DATE_SHARE, NUMBER_SHARE, YMD_SHARE = 0.40, 0.80, 0.80

# Written date forms that are read, with -, / or . between numbers: year first; month first, or day
# first where the first number is no month; eight digits; day and month name in either order; and year and
# month alone, as the first of the month.  Years may have two digits but where they come first.  A
# weekday may stand before, and a time of day, AM or PM and a zone may follow.
MONTHS = ["JANUARY", "FEBRUARY", "MARCH", "APRIL", "MAY", "JUNE", "JULY", "AUGUST", "SEPTEMBER",
          "OCTOBER", "NOVEMBER", "DECEMBER"]
MONTH_NUMBERS = {**{m: k + 1 for k, m in enumerate(MONTHS)}, **{m[:3]: k + 1 for k, m in enumerate(MONTHS)},
                 "SEPT": 9}
NAME = r"(JAN|FEB|MAR|APR|MAY|JUN|JUL|AUG|SEP|OCT|NOV|DEC)[A-Z]*"
WEEKDAY = r"^(MON|TUE|WED|THU|FRI|SAT|SUN)(DAY|SDAY|NESDAY|RSDAY|URDAY|S|RS|R)?\.?,? +"
YEAR = r"(1[6-9]\d{2}|2[01]\d{2})"
# By how a text begins, its forms, rewritten one after the other to year-month-day behind a mark
DATE_SHAPES = [
    (r"^\d{4}[-/.]", [(r"^(\d{4})[-/.](\d{1,2})[-/.](\d{1,2})$", "=$1-$2-$3"),
                      (rf"^{YEAR}[-/](\d{{1,2}})$", "=$1-$2-1")]),
    (r"^\d{8}$", [(r"^(\d{4})(\d{2})(\d{2})$", "=$1-$2-$3")]),
    (r"^\d{1,2}[-/.]\d", [(r"^(1[3-9]|[23]\d)[-/.](\d{1,2})[-/.](\d{4}|\d{2})$", "=$3-$2-$1"),
                          (r"^(\d{1,2})[-/.](\d{1,2})[-/.](\d{4}|\d{2})$", "=$3-$1-$2"),
                          (rf"^(\d{{1,2}})[-/]{YEAR}$", "=$2-$1-1")]),
    (r"^\d{4}", [(rf"^{YEAR}[- ]([A-Z]{{3,9}})\.?$", "=$1-$2-1"),
                 (rf"^{YEAR}[- ]([A-Z]{{3,9}})\.?[- ](\d{{1,2}})(?:ST|ND|RD|TH)?$", "=$1-$2-$3")]),
    (r"^\d", [(r"^(\d{1,2})(?:ST|ND|RD|TH)?[- ]?([A-Z]{3,9})[.,]?[- ](\d{4}|\d{2})$", "=$3-$2-$1")]),
    (r"^[A-Z]", [(r"^([A-Z]{3,9})\.?[- ](\d{1,2})(?:ST|ND|RD|TH)?,?[- ](\d{4})$", "=$3-$1-$2"),
                 (rf"^([A-Z]{{3,9}})\.?,?[- ]{YEAR}$", "=$2-$1-1")])]
# Two-digit years from 69 are of the 20th century (fixed value)
CENTURIES = [(r"^=([0-5]\d|6[0-8])-", "=20$1-"), (r"^=(69|[7-9]\d)-", "=19$1-")]
TIME = r"[T ]+(\d{1,2}):(\d{1,2})(:\d{1,2}(?:\.\d+)?)? ?(AM|PM)? ?(Z|UTC|[+-]\d{1,2}:?\d{2})?$"
HOUR_ONLY = r"^\d{4}[-/]\d{1,2}[-/]\d{1,2}[T ]+\d{1,2}$"
#: Texts that a cast reads as they are, and a cheap look at how other dates begin.
ISO = r"^\d{4}-\d{2}-\d{2}( \d{2}:\d{2}:\d{2}(\.\d{1,6})?)?$"
ANY_DATE = rf"^({WEEKDAY[1:]})?(\d{{1,4}}[-/.]\d|\d{{8}}($|[T ])|(\d{{4}}|\d{{1,2}}(ST|ND|RD|TH)?)[- ]?{NAME}|{NAME}\.?,?[- ]\d)"
NUMERIC = ("tinyint", "smallint", "int", "bigint", "float", "double", "decimal")


def is_numeric(kind: str) -> bool:
    return kind.split("(")[0] in NUMERIC


def parse_date(c) -> Column:
    """Text as UTC date-time without zone; NULL for placeholders and unknown forms.

    A cheap look at how a text begins leaves the rest alone, and picks the few forms to try.  They are
    rewritten to year-month-day first, so one cast reads them all.  Letters count in either case, because text
    columns are lower-cased before dates are looked for again.
    """
    def named(day):
        return let(F.regexp_extract(day, r"-([A-Z]{3,9})-", 1), lambda name: F.when(name == "", day).otherwise(
            F.replace(day, name, F.coalesce(lookup(name, MONTH_NUMBERS).cast("string"), F.lit("?")))))

    def shaped(text):
        out = None
        for begin, forms in DATE_SHAPES:
            day = text
            for form, order in forms:
                day = F.regexp_replace(day, form, order)
            out = F.when(text.rlike(begin), day) if out is None else out.when(text.rlike(begin), day)
        return out

    def rewritten(text):
        def whole(day):
            for form, order in CENTURIES:
                day = F.regexp_replace(day, form, order)
            return day

        return let(shaped(text), lambda d: let(F.when(d.rlike(r"^=\d\d-"), whole(d)).otherwise(d), lambda d: F.when(
            F.startswith(d, F.lit("=")), named(F.substring(d, 2, 20)))))

    def clock(text):
        half = F.regexp_extract(text, TIME, 4)
        time = F.regexp_replace(text, ".*?" + TIME, "$1:$2$3")
        hour = F.substring_index(time, ":", 1).try_cast("int") % 12 + F.when(half == "PM", 12).otherwise(0)
        return F.when(half == "", time).otherwise(
            F.regexp_replace(time, F.lit(r"^\d+"), hour.cast("string")))

    def at_time(text):
        zone = F.regexp_replace(F.regexp_extract(text, TIME, 5), r"^([+-]\d{1,2}):?(\d{2})$", "$1:$2")
        stamp = F.concat(rewritten(F.regexp_replace(text, TIME, "")), F.lit(" "), clock(text), F.replace(zone, F.lit("UTC"), F.lit("Z")))
        return let(F.when(text.rlike(TIME), stamp), lambda s: F.when(
            s.rlike(r":\S*(Z|[+-]\d{1,2}:\d{2})$"), F.convert_timezone(
                F.current_timezone(), F.lit("UTC"), s.try_cast("timestamp").cast("timestamp_ntz")))
            .otherwise(s.try_cast("timestamp_ntz")))

    def read(t):
        return F.when(F.contains(t, F.lit(":")), at_time(t)).otherwise(rewritten(t).try_cast("timestamp_ntz"))

    t = F.upper(F.trim(col(c)))
    plain = F.when(t.rlike(HOUR_ONLY), F.concat(t, F.lit(":00"))).when(
        t.rlike(WEEKDAY), F.regexp_replace(t, WEEKDAY, "")).otherwise(t)
    return F.when(t.rlike(ISO), t.try_cast("timestamp_ntz")).when(t.rlike(ANY_DATE), let(plain, read))


def parse_number(c, european: bool = False) -> Column:
    """Text as double after removing separators, percent and currency signs; number words too."""
    t = F.translate(col(c), ",.$€£¥₹ \t", ".") if european else F.translate(col(c), ",%$€£¥₹", "")
    t = F.trim(t)
    plain = F.when(t.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), t)
    return F.coalesce(plain, F.when(F.length(t) <= 9, lookup(F.lower(t), NUMBER_WORDS))).try_cast("double")


def parse_boolean(c) -> Column:
    t = F.lower(F.trim(col(c)))
    return F.when(t.isin(TRUE_WORDS), True).when(t.isin(FALSE_WORDS), False)


def ymd_date(c) -> Column:
    """A number such as 20101229 as a date; NULL out of range or not a calendar day."""
    x = col(c).cast("double")
    ok = (x >= 19000101) & (x <= 21001231)
    return F.when(ok, F.try_to_timestamp(
        F.floor(x).cast("long").cast("string"), F.lit("yyyyMMdd")).cast("timestamp_ntz"))


def is_id(name: str) -> bool:
    import re

    return re.search(edge_pattern(ID_WORDS), name.lower().replace(" ", "_")) is not None


def keeps_case(name: str) -> bool:
    n = name.lower().replace(" ", "_")
    return any(w in n for w in CASE_WORDS)


def type_profile(df: DataFrame) -> DataFrame:
    """One row per column with the counts every type test needs; one job per table.

    Cells are laid out as (column, value), so the tests are compiled once, however many columns
    there are, and the counts per column combine on the map side.
    """
    def cell(k, c, kind):
        text = col(c) if kind == "string" else F.lit(None).cast("string")
        num = col(c).cast("double") if is_numeric(kind) else F.lit(None).cast("double")
        return F.struct(F.lit(k).alias("position"), col(c).isNotNull().alias("known"),
                        text.alias("t"), num.alias("d"))

    cells = df.select(F.explode(F.array(*[
        cell(k, c, kind) for k, (c, kind) in enumerate(df.dtypes)])).alias("x")).select("x.*")
    tests = cells.select(
        "position", "known", "d",
        (F.col("t").isNotNull() & ~F.lower(F.trim("t")).isin(DATE_PLACEHOLDERS)).alias("real"),
        parse_date("t").isNotNull().alias("is_date"), parse_number("t").alias("n"),
        parse_number("t", True).isNotNull().alias("is_eu_number"),
        F.translate("t", "$€£¥₹ \t", "").alias("bare"),
        parse_boolean("t").isNotNull().alias("is_bool"), ymd_date("d").isNotNull().alias("is_ymd"))
    number = F.coalesce("n", "d")
    counts = tests.groupBy("position").agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_if("known").alias("n_values"),
        F.count_if("real").alias("n_checked"),
        F.count_if(F.col("real") & F.col("is_date")).alias("n_dates"),
        F.count("n").alias("n_numbers"), F.count_if("is_eu_number").alias("n_numbers_eu"),
        F.count_if(F.contains("bare", F.lit(",")) & F.col("bare").rlike(
            r"^-?(\d{1,3}\.)*\d{1,3},\d+$")).alias("n_eu"),
        F.count_if(F.contains("bare", F.lit(".")) & F.col("bare").rlike(
            r"^-?(\d{1,3},)*\d{1,3}\.\d+$")).alias("n_us"),
        F.count_if("is_bool").alias("n_bool"),
        F.count_if(F.col("d").between(19000101, 21001231)).alias("n_ymd_range"),
        F.count_if("is_ymd").alias("n_ymd"),
        F.count_if(number == F.floor(number)).alias("n_whole"))
    at = F.element_at
    names = F.array(*[F.lit(c) for c in df.columns])
    kinds = F.array(*[F.lit(t) for _, t in df.dtypes])
    return counts.withColumns({"column_name": at(names, F.col("position") + 1),
                               "stored_type": at(kinds, F.col("position") + 1)})


def decide_types(profile: DataFrame) -> DataFrame:
    """Add the decided type and its details to a profile."""
    kind = F.col("stored_type")
    name = F.replace(F.lower("column_name"), F.lit(" "), F.lit("_"))
    text, number = kind == "string", kind.rlike("^(tinyint|smallint|int|bigint|float|double|decimal)")
    european = text & (F.col("n_eu") > F.col("n_us"))
    share = lambda a, b: F.coalesce(ratio(a, b), F.lit(0.0))
    numbers = F.when(european, F.col("n_numbers_eu")).otherwise(F.col("n_numbers"))
    date = text & (share("n_dates", "n_checked") >= DATE_SHARE)
    numeric = text & (share(numbers, "n_values") >= NUMBER_SHARE)
    ymd = number & (share("n_ymd_range", "n_values") >= YMD_SHARE) \
        & (share("n_ymd", "n_ymd_range") >= YMD_SHARE)
    boolean = text & (F.col("n_values") > 0) & (F.col("n_bool") == F.col("n_values"))
    decided = (
        F.when(name.rlike(edge_pattern(ID_WORDS)), "id")
        .when(kind.rlike("^(date|timestamp)"), "date").when(date, "date")
        .when(numeric, "numeric").when(kind == "boolean", "boolean").when(ymd, "date")
        .when(number, "numeric").when(boolean, "boolean").otherwise("text"))
    whole = (F.col("n_whole") > 0) & (F.col("n_whole") == F.when(text, F.col("n_numbers"))
                                      .otherwise(F.col("n_values")))
    return profile.withColumn("detected_type", decided).withColumns({
        "is_european": european & (F.col("detected_type") == "numeric"),
        "is_ymd": ymd & (F.col("detected_type") == "date"),
        "is_integer": whole & (F.col("detected_type") == "numeric")})


@dataclass
class TypePlan:
    """Detected types of one table; small metadata that the projections are built from."""

    types: dict[str, str]
    european: set[str] = field(default_factory=set)
    ymd: set[str] = field(default_factory=set)
    integers: set[str] = field(default_factory=set)

    def of(self, kind: str) -> list[str]:
        return [c for c, t in self.types.items() if t == kind]

    @property
    def ids(self) -> list[str]:
        return self.of("id")

    @property
    def numeric(self) -> list[str]:
        return self.of("numeric")

    @property
    def text(self) -> list[str]:
        return self.of("text")

    @property
    def dates(self) -> list[str]:
        return self.of("date")

    @property
    def booleans(self) -> list[str]:
        return self.of("boolean")


def plan_types(df: DataFrame) -> TypePlan:
    """Run the profile job and keep its outcome (one small row per column)."""
    plan = TypePlan({})
    for r in decide_types(type_profile(df)).orderBy("position").collect():
        plan.types[r.column_name] = r.detected_type
        for flag, target in (("is_european", plan.european), ("is_ymd", plan.ymd),
                             ("is_integer", plan.integers)):
            if r[flag]:
                target.add(r.column_name)
    return plan


def cast_types(df: DataFrame, plan: TypePlan) -> DataFrame:
    """Typed table in one projection."""
    stored, out = dict(df.dtypes), []
    for c in df.columns:
        kind, text = plan.types[c], stored[c] == "string"
        x = col(c)
        if kind == "id":
            x = F.trim(x.cast("string"))
        elif kind == "date":
            x = ymd_date(c) if c in plan.ymd else parse_date(c) if text else x.cast("timestamp_ntz")
        elif kind == "numeric" and text:
            x = parse_number(c, c in plan.european)
        elif kind == "boolean" and text:
            x = parse_boolean(c)
        out.append(x.alias(c))
    return df.select(*out)


def redetect_dates(df: DataFrame, plan: TypePlan) -> tuple[DataFrame, TypePlan]:
    """Test text columns for dates again, once placeholders are gone."""
    text = plan.text
    if not text:
        return df, plan
    found = [r.column_name for r in decide_types(type_profile(df.select(*[col(c) for c in text])))
             .where("detected_type = 'date'").select("column_name").collect()]
    types = {c: "date" if c in found else t for c, t in plan.types.items()}
    out = df.withColumns({c: parse_date(c) for c in found}) if found else df
    return out, TypePlan(types, plan.european, plan.ymd, plan.integers)
