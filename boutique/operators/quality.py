"""Data-quality rules as bulk jobs.

Every rule is a native column expression; a rule set splits a batch into valid rows
(normalised: stripped text, digits-only phone) and rejects carrying the list of broken
rules (``errors: array<string>``). Membership rules (geolocation, uniqueness, existing
rows) are joins against distinct key sets, never per-row lookups.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boutique import constants as K
from boutique.functions.numbers import python_float, python_int
from boutique.functions.text import digits_only_phone, strip_python
from boutique.operators.geo import geo_flags
from boutique.session import materialize
from boutique.sources import schemas as S


@dataclass(frozen=True)
class Rule:
    message: str
    ok: Column  # true when the row satisfies the rule (null counts as broken)


def _s(c: str) -> Column:
    return F.col(c).cast("string")


# ---- single-column rules ---------------------------------------------------------------
def non_empty(col: str) -> Column:
    """V1: a string that is not blank after trimming."""
    return F.coalesce(F.length(strip_python(_s(col))) > 0, F.lit(False))


def positive_number(col: str) -> Column:
    """V2: parses as a number and is > 0."""
    v = python_float(col)
    return F.coalesce((v > 0) & ~F.isnan(v), F.lit(False))


def storable_money(col: str) -> Column:
    """Not a number, or one that a money column holds (below 10**8)."""
    v = python_float(col)
    return F.coalesce(F.abs(v) < 99_999_999.99, F.lit(True))


def storable_int(col: str) -> Column:
    """Not a number, or one that an integer column holds."""
    v = python_float(col)
    return F.coalesce(F.abs(v) < 2_147_483_647.0, F.lit(True))


def integer_or_null(col: str) -> Column:
    """Null, or parses as a 32-bit integer."""
    return F.col(col).isNull() | python_int(col).isNotNull()


def non_negative_int(col: str) -> Column:
    """V3: parses as an integer and is >= 0."""
    return F.coalesce(python_int(col, "bigint") >= 0, F.lit(False))


def valid_year(col: str, as_of_year: int) -> Column:
    """V4: an integer year in 1970 .. as_of_year + 2."""
    y = python_int(col)
    return F.coalesce(y.between(K.MIN_RELEASE_YEAR, as_of_year + K.RELEASE_YEAR_SLACK), F.lit(False))


def valid_email(col: str) -> Column:
    """V5: contains '@', a dot after the last '@', and at most 254 characters."""
    v = strip_python(_s(col))
    after = F.substring_index(v, "@", -1)
    return F.coalesce(
        v.contains("@") & after.contains(".") & (F.length(v) <= K.EMAIL_MAX_LENGTH), F.lit(False)
    )


def valid_phone(col: str) -> Column:
    """V6: blank allowed; otherwise 0, a digit 1-9 and 8 digits once separators are removed."""
    v = strip_python(_s(col))
    return v.isNull() | (v == "") | F.coalesce(digits_only_phone(col).rlike(K.PHONE_PATTERN), F.lit(False))


def valid_zip(col: str) -> Column:
    """V7: exactly five digits."""
    return F.coalesce(strip_python(_s(col)).rlike(K.ZIP_PATTERN), F.lit(False))


def valid_score(col: str) -> Column:
    """An integer from 1 to 5."""
    v = python_int(col)
    return F.coalesce(v.between(K.REVIEW_SCORE_MIN, K.REVIEW_SCORE_MAX), F.lit(False))


def valid_status(col: str) -> Column:
    """One of the five allowed statuses."""
    return F.coalesce(F.col(col).isin(*K.ORDER_STATUSES), F.lit(False))


def consistent_stock() -> Column:
    """available = in stock - reserved, and not negative."""
    return F.coalesce(
        (F.col("quantity_available") == F.col("quantity_in_stock") - F.col("quantity_reserved"))
        & (F.col("quantity_available") >= 0),
        F.lit(False),
    )


# ---- applying rules ----------------------------------------------------------------------
def check(df: DataFrame, rules: list[Rule]) -> DataFrame:
    """Add ``errors``: the messages of the broken rules, in rule order (empty when valid)."""
    msgs = [F.when(~r.ok, F.lit(r.message)) for r in rules]
    return df.withColumn("errors", F.array_compact(F.array(*msgs)))


def with_unique_flag(df: DataFrame, key: str, flag: str) -> DataFrame:
    """Add ``flag`` = no other row of the batch has the same (non-null) key.

    A per-key count (partial aggregation, so a key repeated millions of times is counted
    in parallel) joined back on the key; AQE splits a hot key on the large side.
    """
    counts = df.groupBy(key).agg(F.count(F.lit(1)).alias("_kn"))
    return df.join(counts, key, "left").withColumn(
        flag, F.coalesce(F.col("_kn") == 1, F.lit(True))
    ).drop("_kn")


def check_unique(checked: DataFrame, key: str, message: str) -> DataFrame:
    """Among the rows without errors so far, keys must be unique. With a batch sequence (a
    column ``seq``) the first valid row of a key stands, by seq (null last) and then by its
    content, one of equal rows; the others get ``message``. Without, all of them do. Invalid
    rows don't count. The row that stands is one aggregate per key (combined map-side)."""
    valid = F.size("errors") == 0
    rows = materialize(checked.withColumn("_row", F.monotonically_increasing_id()))
    usable = rows.filter(valid & F.col(key).isNotNull())
    if "seq" in checked.columns:
        content = [F.col(c) for c in sorted(checked.columns) if c not in ("seq", "errors", key)]
        first = F.min(F.struct(F.col("seq").isNull().alias("_last"), "seq", *content, "_row"))["_row"]
    else:
        first = F.when(F.count(F.lit(1)) == 1, F.min("_row")).otherwise(F.lit(-1))
    keys = usable.groupBy(key).agg(first.alias("_first"))
    stands = F.coalesce(F.col("_row") == F.col("_first"), F.lit(True))
    return rows.join(keys, key, "left").withColumn(
        "errors", F.when(valid & ~stands, F.array(F.lit(message))).otherwise(F.col("errors"))).drop("_row", "_first")


def with_absent_flag(df: DataFrame, table: DataFrame, key: str, flag: str,
                     table_key: str | None = None, normalise=None) -> DataFrame:
    """Add ``flag`` = the key is not present in ``table`` (an anti-membership via left join
    to the table's distinct keys)."""
    tk = table_key or key
    norm = normalise or (lambda c: c)
    keys = table.select(norm(F.col(tk)).alias("_k")).dropna().distinct().withColumn("_hit", F.lit(True))
    j = df.join(keys, norm(F.col(key)) == F.col("_k"), "left")
    return j.withColumn(flag, F.col("_hit").isNull()).drop("_k", "_hit")


# ---- rule sets of the shop ----------------------------------------------------------------
def customer_batch_check(batch: DataFrame, customers: DataFrame, geolocation: DataFrame) -> DataFrame:
    """V1, V5-V9 for customer rows about to be added (the shop's add/register checks)."""
    # One stripped email is validated, compared and stored.
    b = geo_flags(batch.withColumn("email", strip_python("email")), geolocation)
    b = with_absent_flag(b, customers, "email", "_email_new", normalise=strip_python)
    rules = [
        Rule("first_name: must not be empty", non_empty("first_name")),
        Rule("last_name: must not be empty", non_empty("last_name")),
        Rule("email: invalid", valid_email("email")),
        Rule("phone: 10 digits starting with 0", valid_phone("phone")),
        Rule("zip_code_prefix: exactly 5 digits", valid_zip("zip_code_prefix")),
        Rule("zip_code_prefix: unknown", F.col("zip_ok")),
        Rule("city: unknown", F.col("city_ok")),
        Rule("state: unknown", F.col("state_ok")),
        Rule("email: already registered", F.col("_email_new")),
    ]
    out = check_unique(check(b, rules), "email", "email: duplicated in batch")
    return out.drop("zip_ok", "city_ok", "state_ok", "_email_new").withColumn(
        "phone", F.when(F.trim("phone") == "", F.lit("")).otherwise(digits_only_phone("phone")))


def customer_table_check(customers: DataFrame, geolocation: DataFrame) -> DataFrame:
    """The same rules applied to the stored customers (emails unique within the table)."""
    b = geo_flags(customers, geolocation)
    b = with_unique_flag(b, "email", "_email_once")
    rules = [
        Rule("first_name: must not be empty", non_empty("first_name")),
        Rule("last_name: must not be empty", non_empty("last_name")),
        Rule("email: invalid", valid_email("email")),
        Rule("phone: 10 digits starting with 0", valid_phone("phone")),
        Rule("zip_code_prefix: exactly 5 digits", valid_zip("zip_code_prefix")),
        Rule("zip_code_prefix: unknown", F.col("zip_ok")),
        Rule("city: unknown", F.col("city_ok")),
        Rule("state: unknown", F.col("state_ok")),
        Rule("email: duplicated", F.col("_email_once")),
    ]
    return check(b, rules).drop("zip_ok", "city_ok", "state_ok", "_email_once")


def product_rules(as_of_year: int) -> list[Rule]:
    """V1, V2, V4 for products."""
    return [
        Rule("product_name: must not be empty", non_empty("product_name")),
        Rule("product_category: must not be empty", non_empty("product_category")),
        Rule("product_platform: must not be empty", non_empty("product_platform")),
        Rule("product_esrb_rating: must not be empty", non_empty("product_esrb_rating")),
        Rule("product_release_year: out of range", valid_year("product_release_year", as_of_year)),
        Rule("product_price: must be > 0", positive_number("product_price")),
        Rule("product_price: too large", storable_money("product_price")),
        Rule("product_weight_g: must be > 0", positive_number("product_weight_g")),
        Rule("product_weight_g: too large", storable_int("product_weight_g")),
    ]


def review_batch_check(batch: DataFrame, orders: DataFrame, reviews: DataFrame) -> DataFrame:
    """Score 1..5; the order exists; no review yet; one per order in the batch."""
    b = with_absent_flag(batch, orders, "order_id", "_no_order")
    b = with_absent_flag(b, reviews, "order_id", "_not_reviewed")
    rules = [
        Rule("order_id: unknown order", ~F.col("_no_order")),
        Rule("order_id: already reviewed", F.col("_not_reviewed")),
        Rule("review_score: integer from 1 to 5", valid_score("review_score")),
    ]
    checked = check_unique(check(b, rules), "order_id", "order_id: duplicated in batch")
    return checked.drop("_no_order", "_not_reviewed")


def stock_check(stock: DataFrame) -> DataFrame:
    """V13 over a stock table."""
    return check(stock, [Rule("quantity_available: must equal in stock - reserved and be >= 0",
                              consistent_stock())])


def split_existing(changes: DataFrame, table: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(changes whose target exists, changes rejected as not found)."""
    keys = table.select(key)
    found = changes.join(keys, key, "left_semi")
    missing = changes.join(keys, key, "left_anti").withColumn("errors", F.array(F.lit(f"{key}: not found")))
    return found, missing


# ---- key report (V14) ----------------------------------------------------------------------
def _key_string(cols: tuple[str, ...]) -> Column:
    return F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("∅")) for c in cols])


def key_report(tables: dict[str, DataFrame]) -> DataFrame:
    """V14 (keys): primary- and unique-key values held by more than one row."""
    parts = []
    for name, df in tables.items():
        keysets = [("primary", S.PRIMARY_KEYS.get(name))] + [
            ("unique", k) for k in S.UNIQUE_KEYS.get(name, ())
        ]
        for kind, cols in keysets:
            if not cols:
                continue
            dup = df.groupBy(*cols).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1)
            parts.append(dup.select(
                F.lit(name).alias("table_name"), F.lit(kind).alias("key_kind"),
                F.lit(",".join(cols)).alias("key_columns"), _key_string(cols).alias("key_value"), "n",
            ))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def foreign_key_report(tables: dict[str, DataFrame]) -> DataFrame:
    """V14 (references): child key values with no parent row, with their row counts."""
    parts = []
    for child, ccols, parent, pcols in S.FOREIGN_KEYS:
        if child not in tables or parent not in tables:
            continue
        c = tables[child].select(*[F.col(a).alias(f"_c{i}") for i, a in enumerate(ccols)])
        p = tables[parent].select(*[F.col(b).alias(f"_c{i}") for i, b in enumerate(pcols)])
        keys = [f"_c{i}" for i in range(len(ccols))]
        # Only orphans are counted: a task holds no table of all the keys it sees.
        orphans = c.dropna().join(p, keys, "left_anti").groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
        parts.append(orphans.select(
            F.lit(child).alias("table_name"), F.lit(",".join(ccols)).alias("key_columns"),
            F.lit(parent).alias("parent_table"), _key_string(tuple(keys)).alias("key_value"), "n",
        ))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
