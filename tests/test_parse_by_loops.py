"""Every component of a parsed name against plain loops over its words: strengths without a unit, packs, brands and how they grow."""

import random
import re

from weftline.functions import words as W
from weftline.functions.parse import parse_names
from weftline.operators import blocking as B

DIGIT = re.compile("[0-9]")
FIELDS = ("brand", "dosage_nums", "dosage_units", "qty", "volume", "weight", "form", "flavor", "brand_variants")


def tidy(x):
    """As names have it: a leading zero goes only before a digit."""
    if "." not in x:
        return x
    while len(x) > 1 and x[0] == "0" and x[1].isdigit():
        x = x[1:]
    while x.endswith("0"):
        x = x[:-1]
    return x.removesuffix(".")


def strengths(n):
    both = re.search(W.COMBINED_MG_PER_ML, n)
    if both:
        return [f"{both[1]}/{both[2]}"], ["MG/ML"]
    per = re.search(W.MG_PER_ML, n)
    if per:
        return [per[1]], ["MG/ML"]
    found = re.findall(W.DOSAGE, n)
    return ["".join(a.split()) for a, _ in found], [u for _, u in found]


def brand(w):
    infusion = any(x in W.INFUSION for x in w)
    stops = []
    for i, x in enumerate(w):
        hard = x in W.FORM_PREFIXES or x in W.FORM_WORDS or x in W.NOISE or x in W.BRAND_QUALIFIERS or x == "GELATIN"
        soft = i > 0 and (x in W.SOFT_DESCRIPTORS or x in W.CONNECTORS or x in W.FLAVORS or x in W.SUPPLEMENTS)
        stops.append(bool(DIGIT.search(x)) or hard or soft or (x == "INF" and i > 0 and not infusion))
    lead = ""
    for x, stop in zip(w, stops, strict=True):
        if stop:
            break
        lead += x
    if w and w[0] in W.ACRONYM_BRANDS:
        return w[0]
    if lead:
        return lead
    return "".join(x for x, s in list(zip(w, stops, strict=True))[1:] if not s) if w and w[0] in W.BRAND_QUALIFIERS else ""


def variants(w, own):
    infusion, out = any(x in W.INFUSION for x in w), [own]
    grown = ""
    for i, x in enumerate(w):
        link = x in W.CONNECTORS
        if DIGIT.search(x) or x in W.FORM_PREFIXES or x in W.FORM_WORDS or x in W.NOISE or (x == "INF" and i > 0 and not infusion) or (i > 0 and not link and x in W.BRAND_QUALIFIERS):
            break
        if i and link:
            continue
        grown += x
        out.append(grown)
        if i and x in W.SOFT_DESCRIPTORS:
            break
    seen = []
    for v in (re.sub("[^A-Z0-9]", "", v) for v in out):
        if len(v) >= 3 and v not in seen:
            seen.append(v)
    return seen


def parsed(n):
    w = n.split()
    last = lambda p: ([m[1] for m in re.finditer(p, n)] or [""])[-1]
    weight, volume = last(W.WEIGHT), last(W.VOLUME)
    pack = m[1] if (m := re.search(W.PACK, n)) else ""
    nums, units = strengths(n)
    own = brand(w)
    if own == "ATOMOXAPEX" and nums == ["40"] and volume == "100":
        nums, units = ["4"], ["MG/ML"]
    form = next((f for f in W.FORM_ORDER if f in w), "")
    for name, spellings in W.FORM_NAMES.items():
        if form in spellings.split():
            form = name
            break
    if form == "SUSP" and ("EYE" in w or "DROPS" in w):
        form = "EYE"
    if not nums and pack.isdigit() and int(pack) >= 100 and "VAGINAL" in w and form in ("CAP", "SUPP"):
        pack = ""
    slash = m[0] if (m := re.search(rf"\b{W.NUMBER}\s*/\s*{W.NUMBER}\b", n)) else ""
    left = [tidy(x) for x in re.findall(rf"\b{W.NUMBER}\b", n)]
    for x in (pack, volume, weight):
        if x and tidy(x) in left:
            left.remove(tidy(x))
    if not nums:
        if slash:
            nums, units = ["".join(slash.split())], ["MG"]
        elif len(left) == 1 and (pack or form in ("TAB", "CAP", "SUPP", "AMP", "VIAL", "SPRAY") or (volume and form in ("SYRUP", "SUSP"))):
            nums, units = left, ["MG"]
        elif weight and ((form == "TAB" and {"EFF", "EFFERVESCENT"} & set(w)) or form in ("VIAL", "AMP") or any(x in W.INFUSION for x in w)):
            nums, units = [weight], ["GM"]
    flavor = next((f for f in W.FLAVORS if f in w), "")
    return dict(zip(FIELDS, (own, nums, units, pack, volume, weight, form, flavor, variants(w, own)), strict=True))


def some_names(seed, n):
    r = random.Random(seed)
    pools = [["ATOMOXAPEX", "PANADOL", "ZETA", "CO DIOVAN", "AIG", "OMEGA", "NAN", "B12"], W.SOFT_DESCRIPTORS, W.BRAND_QUALIFIERS[:20], W.CONNECTORS, W.FLAVORS, W.FORM_WORDS[:25], W.FORM_ORDER, ["INF", "GELATIN", "VAGINAL", "EFF", "IV", "I/V", "EYE", "DROPS"], W.NOISE]
    amounts = ["40 MG", "100 ML", "5 MG/5 ML", "10/20 MG/ML", "400 MG/57 MG/5 ML", "2.50 %", "200 000 IU", "1 GM", "15 G", "30 TAB", "20 F.C TAB", "100 CAP", "200 VAGINAL SUPP", "5/160", "160 / 12.5", "12.50", "7", "0.5", "24", "3"]
    out = ["ATOMOXAPEX 40 MG SYRUP 100 ML", "X 1200 VAGINAL CAP", "", "EFF 1 GM TAB", "AMP 2 GM", "WHITE", "PLUS ZETA 5"]
    while len(out) < n:
        words = [r.choice(r.choice(pools)) if r.random() < 0.55 else r.choice(amounts) for _ in range(r.randrange(1, 7))]
        out.append(" ".join([r.choice(pools[0]), *words] if r.random() < 0.7 else words))
    return out


def test_components_equal_plain_loops(spark):
    df = spark.createDataFrame([(i, n) for i, n in enumerate(some_names(1, 1200))], "id long, name string")
    rows = parse_names(df, "name", "d").select("id", "name", "d.*").collect()
    kinds = set()
    for r in rows:
        want = parsed(r.normalized)
        got = {f: r[f] if isinstance(r[f], str) else list(r[f]) for f in FIELDS}
        assert got == want, (r.name, r.normalized)
        kinds.add((bool(want["dosage_nums"]), bool(want["qty"]), bool(want["volume"]), bool(want["weight"]), want["dosage_units"][:1] == ["GM"], len(want["brand_variants"]) > 1))
    assert len(rows) == 1200 and len(kinds) > 15


def test_component_keys_equal_plain_loops(spark):
    """Pairs of items and rows that share a key: a brand variant alone, or with volume, pack, strengths or flavour."""
    keys = lambda d: {k for v in d["brand_variants"] for k in [("brand", v), *((kind, v, x) for kind, x in (("volume", d["volume"]), ("qty", d["qty"]), ("dosage", ",".join(d["dosage_nums"])), ("flavor", d["flavor"])) if x)]}
    d = parse_names(spark.createDataFrame([(i, n) for i, n in enumerate(some_names(2, 120))], "id long, name string"), "name", "d")
    m = parse_names(spark.createDataFrame([(i, n) for i, n in enumerate(some_names(3, 150))], "row long, name string"), "name", "m")
    x = {r.id: keys(parsed(r.n)) for r in d.selectExpr("id", "d.normalized as n").collect()}
    y = {r.row: keys(parsed(r.n)) for r in m.selectExpr("row", "m.normalized as n").collect()}
    want = {(i, j): len(a & b) for i, a in x.items() for j, b in y.items() if a & b}
    got = {(r.id, r.row): r["keys"] for r in B.pairs_by_keys(d, "id", B.component_keys("d"), m, "row", B.component_keys("m")).collect()}
    assert got == want and len(want) > 500
