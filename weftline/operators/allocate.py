"""Prices, discounts and the split of a quantity over offers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.functions.normalize import store_name, text
from weftline.operators import running
from weftline.operators.decide import first_of_each
from weftline.shared import Scratch

# Where a discount stands in a payload, in order.
DISCOUNT_KEYS = (
    "discountPercent discountPercentage discountRate discountValue discount cashDiscount companyDiscount offerDiscount pharmacyDiscount percentage percent"
).split()
NESTED_KEYS = "store supplier warehouse pharmacy branch seller".split()
PRICE_KEYS = "retailPrice publicPrice price sellingPrice".split()
IDENTITY_KEYS = "storeProductId productStoreId storeId supplierId id".split()
NAME_KEYS = "name nameAr nameEn arabicName englishName title".split()


def price(c: Column) -> Column:
    """A positive number from text, whatever else stands around its digits and dots."""
    x = F.regexp_replace(text(c), r"[^0-9.]", "").try_cast("double")
    return F.when(x > 0, x)


def price_delta(old: Column, new: Column) -> Column:
    """`+1.50 (10.0%)`, signed; empty without two prices."""
    off = new - old
    # DecimalFormat rounds what the double is, halves to even; format_string rounds its shortest decimal form, halves up
    digits = lambda x, form: F.call_function("format_number", x, F.lit(form))
    shown = F.concat(F.when(off >= 0, "+").otherwise("-"), digits(F.abs(off), "0.00"), F.lit(" ("), digits(F.abs(off) / old * 100, "0.0"), F.lit("%)"))
    return F.when((old > 0) & (new > 0), shown).otherwise("")


def _json(payload: Column, path: str) -> Column:
    v = F.get_json_object(payload, f"$.{path}")
    return F.when((v != "") & ~v.rlike(r"^\s*[\[{]"), v)


def _keyed(payload: Column, key: str, *values: Column) -> Column:
    """The first of values, all of paths through key; a payload that doesn't hold the key letter for letter is not parsed. Escapes could spell it otherwise."""
    return F.when(payload.contains(f'"{key}"') | payload.contains("\\"), F.coalesce(*values))


def first_discount(payload: Column) -> Column:
    """The first discount of a JSON payload: under its own keys, in objects under them, in nested sellers, else from its prices."""
    inner = lambda o: (_keyed(payload, k, _json(payload, f"{o}.{k}")) for k in DISCOUNT_KEYS)
    flat = [_keyed(payload, k, _json(payload, k), *inner(k)) for k in DISCOUNT_KEYS]
    nested = [_keyed(payload, o, *inner(o)) for o in NESTED_KEYS]
    number = lambda k: _keyed(payload, k, F.regexp_replace(_json(payload, k), ",", "").try_cast("double"))
    public, sale = F.coalesce(*(number(k) for k in PRICE_KEYS)), number("salePrice")
    derived = F.when((public > 0) & (sale > 0) & (sale < public), F.bround((public - sale) / public * 100, 2).cast("string"))
    return F.coalesce(*flat, *nested, derived)


def discount_percent(c: Column) -> Column:
    """A number out of text, a rate between 0 and 1 as per cent; -1 without one."""
    num = F.replace(F.regexp_extract(text(c), r"-?\d+(?:[.,]\d+)?", 0), F.lit(","), F.lit(".")).try_cast("double")
    return F.coalesce(F.when((num > 0) & (num < 1), num * 100).otherwise(num), F.lit(-1.0))


def format_discount(c: Column) -> Column:
    """`12.5%`: no zeros at the end; text without a number stays; a rate is scaled unless a per cent mark follows."""
    raw = F.trim(text(c))
    found = F.regexp_extract(raw, r"-?\d+(?:[.,]\d+)?", 0)
    num = F.replace(found, F.lit(","), F.lit(".")).try_cast("double")
    num = F.when(~raw.rlike("[%٪]") & (num > 0) & (num < 1), num * 100).otherwise(num)
    shown = F.regexp_replace(F.regexp_replace(F.format_string("%.6f", num), r"0+$", ""), r"\.$", "")
    return F.when((raw == "") | (found == ""), raw).otherwise(F.concat(shown, F.lit("%")))


def offer_identity(payload: Column, ordinal: Column) -> Column:
    keyed = [_keyed(payload, k, F.concat(F.lit(f"{k}:"), _json(payload, k))) for k in IDENTITY_KEYS]
    name = _keyed(payload, "storeName", _json(payload, "storeName"))
    return F.coalesce(*keyed, F.concat_ws(":", F.lit("storeName"), F.coalesce(name, F.lit("")), ordinal))


def enrich_company(payload: Column) -> Column:
    flat = [_keyed(payload, k, _json(payload, k)) for k in ("companyName", "supplierName", "storeName")]
    return F.coalesce(*flat, *(_keyed(payload, o, *(_json(payload, f"{o}.{n}") for n in NAME_KEYS)) for o in NESTED_KEYS))


def _pieces(c: Column) -> Column:
    """All stretches of one to three letters."""
    at = lambda i: F.array(*(F.substring(c, i, F.lit(n)) for n in (1, 2, 3)))
    return F.array_distinct(F.flatten(F.transform(F.sequence(F.lit(1), F.length(c)), at)))


def preferred_priority(offers: DataFrame, preferred: DataFrame, name: str = "store_name") -> DataFrame:
    """offers with `priority`: the first place in the list whose name equals, holds or is held by the offer's; 999 without one.

    A name that holds another holds the other's first three letters: an equi-join on these finds the pairs, each distinct name
    once, however long the list is. Names without a letter match nothing.
    """
    names = offers.select(name).distinct().withColumn("_n", store_name(F.col(name))).filter("_n <> ''")
    lists = preferred.select("position", store_name(F.col("preferred_name")).alias("_p")).filter("_p <> ''")
    begin, every = (lambda c: F.left(F.col(c), F.lit(3)).alias("_k")), (lambda c: F.explode(_pieces(F.col(c))).alias("_k"))
    held = names.select(name, "_n", every("_n")).join(lists.select("position", "_p", begin("_p")), "_k").filter(F.col("_n").contains(F.col("_p")))
    holds = names.select(name, "_n", begin("_n")).join(lists.select("position", "_p", every("_p")), "_k").filter(F.col("_p").contains(F.col("_n")))
    found = held.select(name, "position").unionByName(holds.select(name, "position")).groupBy(name).agg(F.min("position").alias("priority"))
    return offers.join(found, name, "left").withColumn("priority", F.coalesce("priority", F.lit(999)))


def discount_tier(c: Column) -> Column:
    return F.rint(c / 0.3)


def eligible(quantity: Column, discount: Column, least: Column | float = 0.0) -> Column:
    return (quantity > 0) & (discount >= (least if isinstance(least, Column) else F.lit(least)) - 0.001)


def offer_order(mode: str) -> list[Column]:
    """Best first; offers alike in all stand as they came."""
    tier, first = F.desc("_tier"), F.asc("offer_ord")
    orders = {
        "first_available": [first],
        "max_available": [F.desc("available"), tier, F.asc("priority"), first],
        "max_discount": [tier, F.asc("priority"), F.desc("available"), first],
    }
    return orders[mode]


def choose_offer(offers: DataFrame, mode: str, product: str = "product_id", least: float = 0.0) -> DataFrame:
    """One offer a product. offers: product, offer_ord, available, discount, priority."""
    d = offers.filter(eligible(F.col("available"), F.col("discount"), least)).withColumn("_tier", discount_tier(F.col("discount")))
    return first_of_each(d, [product], offer_order(mode)).drop("_tier")


#: Offers of a product from which it is no single task's work.
HOT_OFFERS = 200_000


def _given(d: DataFrame, mode: str, before) -> DataFrame:
    """Offers in their order with `_given`, what those before them give; before(rows, sums=, maxima=) runs along the order."""
    if mode == "max_discount":
        # an offer below the best taken is passed over; since those taken only rise, the best taken is the best that came
        d = before(d, maxima={"_best": F.col("discount")})
        d = d.filter(F.col("_best").isNull() | (F.col("discount") >= F.col("_best") - 0.001))
        d = before(d, maxima={"_stopped": (F.col("discount") < F.col("_top") - 0.5).cast("int")}).filter("coalesce(_stopped, 0) = 0")
    return before(d, sums={"_given": F.col("available")})


def allocate(demand: DataFrame, offers: DataFrame, mode: str, product: str = "product_id", least: float = 0.0, hot: int = HOT_OFFERS) -> DataFrame:
    """(product, offer_ord, discount, ordered): how much each offer gives, in the mode's order, until the demand is met.

    In `max_discount` each offer must also reach the best discount taken so far, and an offer more than half a point
    below the product's best is the last. Discounts fall along the order but within a tier, so those rules are running
    maxima over the order, and the sums that remain are running sums. A product's offers are a window's; those of products that
    have more than `hot` run over ranges (`running`), in many tasks. offer_ord must tell a product's offers apart.
    """
    d = offers.filter(eligible(F.col("available"), F.col("discount"), least)).withColumn("_tier", discount_tier(F.col("discount")))
    d = d.join(demand.select(product, "qty"), product)
    if mode == "max_discount":
        d = d.join(offers.filter("available > 0").groupBy(product).agg(F.max("discount").alias("_top")), product)
    w = Window.partitionBy(product).orderBy(*offer_order(mode)).rowsBetween(Window.unboundedPreceding, -1)

    def windows(rows: DataFrame, sums: dict | None = None, maxima: dict | None = None) -> DataFrame:
        run = {n: F.coalesce(F.sum(c).over(w), F.lit(0)) for n, c in (sums or {}).items()} | {n: F.max(c).over(w) for n, c in (maxima or {}).items()}
        return rows.withColumns(run)

    scratch = Scratch(offers.sparkSession)
    many = scratch.save(offers.groupBy(product).agg(F.count("*").alias("_n")).filter(F.col("_n") > hot).select(product), "many")  # total / hot products at most
    keep = (product, "offer_ord", "discount", "available", "qty", "_given")
    if many.isEmpty():
        d = _given(d, mode, windows).select(*keep)
    else:
        rest = _given(d.join(many, product, "left_anti"), mode, windows).select(*keep)
        split = running.ranged(d.join(many, product, "left_semi"), [product], offer_order(mode), scratch)
        d = rest.unionByName(_given(split, mode, lambda rows, **of: running.before(rows, [product], **of)).select(*keep))
    d = d.withColumn("ordered", F.greatest(F.lit(0), F.least(F.col("available"), F.col("qty") - F.col("_given"))))
    return d.filter("ordered > 0").select(product, "offer_ord", "discount", "ordered")


def selections_text(allocated: DataFrame, product: str = "product_id", label: str = "offer_ord") -> DataFrame:
    """product, total, selections: `label (qty n)` joined by ` | ` in offer order."""
    one = F.struct(F.col("offer_ord"), F.concat(F.col(label).cast("string"), F.lit(" (qty "), F.col("ordered").cast("string"), F.lit(")")).alias("t"))
    d = allocated.groupBy(product).agg(F.sum("ordered").alias("total"), F.array_sort(F.collect_list(one)).alias("s"))
    return d.select(product, "total", F.array_join(F.transform("s", lambda x: x["t"]), " | ").alias("selections"))


def split_selections(stores: Column, discounts: Column, most: int = 5) -> list[Column]:
    """`a | b` texts of stores and discounts as columns store_1, discount_1, ..., best discount first."""
    part = lambda c: F.transform(F.split(text(c), r"\|"), lambda x: F.trim(x))
    pairs = F.arrays_zip(part(stores).alias("s"), part(discounts).alias("d"))
    keyed = F.transform(pairs, lambda z, i: F.struct((-discount_percent(z["d"])).alias("k"), i.alias("i"), z["s"].alias("s"), z["d"].alias("d")))
    keyed = F.array_sort(F.filter(keyed, lambda z: z["s"] != ""))
    return [c for k in range(most) for c in (F.get(keyed, F.lit(k))["s"].alias(f"store_{k + 1}"), F.get(keyed, F.lit(k))["d"].alias(f"discount_{k + 1}"))]


def max_discounts(offers: DataFrame, product: str = "product_id") -> DataFrame:
    """The best discount that is in stock, 0 without one."""
    return offers.groupBy(product).agg(F.coalesce(F.max(F.when(F.col("available") > 0, F.col("discount"))), F.lit(0.0)).alias("max_discount"))
