"""Personal data: candidate generators, boosted trees, calibrated redaction.

Generators of high recall propose spans, which may overlap: four base ones
(email, ip, card, phone - the patterns of the contract) and looser ones for
the same kinds (spelled-out addresses, numbers without a plus or with other
separators, IPv6).  A base span that passes its kind's test always stays.
A looser span has to pass a test of form as well, and then gradient-boosted
trees decide, with features of format and context.  Their labels do not come
from that test: they are learnt from written examples (``examples``), in which
every looser generator proposes personal data as well as hard negatives of the
same form (an address and the end of a sentence, a telephone and an order
number ...).  For each kind a threshold is calibrated on examples kept from
training, where at least ``PRECISION`` of what reaches it is personal data.
Such spans never overlap base ones; of those that overlap each other the best
stays.

Everything runs as DataFrame expressions: a text is cut by each pattern
(``split`` and ``regexp_extract_all`` see the same matches), and positions, in
code points, are running sums of the pieces' lengths.  Patterns are written
with possessive quantifiers and anchored at the start of a run, so a text is
scanned in linear time.  Only the proposals are shuffled, never the texts.

Edge cases: NULL text is empty and has no spans; NULL and repeated doc_ids are
rows of their own; an empty table gives no rows.  Other columns are ignored
(``redact`` keeps them).
"""

from __future__ import annotations

import random

import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import written

EXAMPLES = 1500              # of each generator
PRECISION = 0.99
CONTEXT = 24
KINDS = ["email", "ip", "card", "phone"]
L = "A-Za-z0-9._%+-"
#: kind, pattern.  The first four are the contract's (see the module's text).
GENERATORS = [
    ("email", rf"(?:(?<![{L}])|\G)[{L}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"),
    ("ip", r"(?:(?<![0-9])|\G)[0-9]++(?:\.[0-9]++){3}"),
    ("card", r"[0-9](?:[\x20-]?[0-9])++"),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"),
    ("email", rf"(?<![{L}])[{L}]{{1,64}}+\x20?(?:\[at\]|\(at\)|\{{at\}}|\x20at\x20|@)\x20?[A-Za-z0-9-]{{1,63}}+"
              r"(?:(?:\x20?(?:\[dot\]|\(dot\)|\{dot\})\x20?|\x20dot\x20|\.)[A-Za-z0-9-]{1,63}+){1,4}+"),
    ("ip", r"(?<![0-9A-Za-z:])(?:[0-9A-Fa-f]{0,4}:){2,7}(?:[0-9A-Fa-f]{1,4}|(?<=::))(?![0-9A-Za-z])(?!:[0-9A-Fa-f:])"),
    ("card", r"(?<![0-9A-Za-z._/-])[0-9]{4}(?:[._/\x20-]{1,2}[0-9]{4}){3}(?![0-9A-Za-z])"),
    ("phone", r"(?<![0-9A-Za-z+(.-])(?:00[0-9]{1,3}[\x20.-])?\(?[0-9]{3}\)?[\x20.-]{1,2}[0-9]{3}[\x20.-][0-9]{4}(?![0-9A-Za-z.-])"),
]
BASE, IPV6 = 4, 5
TOP = r"(?:com|org|net|edu|gov|info|io|example|test|co|uk|de|fr|es|it|nl|eu|us|ca|jp|cn|in|br|ru|pl|se|ch|at|be|au)"
COUNTERS = r"(?i)(?:order|invoice|ref|item|part|number|no\.?|id|serial|isbn|sku|ticket|case|batch|row|version|code)[\x20:#]*$"
HINTS = r"(?i)mail|phone|call|tel|fax|mobile|card|visa|pay|ip|host|server|address|contact|reach"


def digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def luhn(d: Column) -> Column:
    """Luhn test of a string of 12 to 19 digits (false for other lengths)."""
    places = F.sequence(F.lit(1), F.greatest(F.length(d), F.lit(1)))
    each = lambda i: (F.ascii(F.substring(F.reverse(d), i, F.lit(1))) - 48) * F.when(i % 2 == 0, 2).otherwise(1)
    total = F.aggregate(F.transform(places, each), F.lit(0),
                        lambda t, x: t + F.when(x > 9, x - 9).otherwise(x))
    return F.when(F.length(d).between(12, 19), total % 10 == 0).otherwise(False)


def passes(g: Column, kind: Column, match: Column) -> Column:
    """The test of form that a span has to pass: its kind's, but for IPv6 its
    own (eight groups, or two to seven around one ``::``)."""
    n = F.length(digits(match))
    octets = match.rlike(r"^0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"
                         r"(?:\.0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])){3}$")
    group, some = "[0-9A-Fa-f]{1,4}", "(?:[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4})*)?"
    groups = F.size(F.filter(F.split(match, ":"), lambda x: x != ""))
    six = match.rlike(f"^(?:{group}:){{7}}{group}$") | (match.rlike(f"^{some}::{some}$") & groups.between(2, 7))
    return (F.when(g == IPV6, six).when(kind == "ip", octets).when(kind == "card", n.between(16, 19) & luhn(digits(match)))
            .when(kind == "phone", n.between(8, 15)).otherwise(True))


def proposals(docs: DataFrame, text: Column, keep: list[str]) -> DataFrame:
    """``keep`` columns and ``cands``: what every generator proposes."""
    df = docs.select(*keep, F.coalesce(text.cast("string"), F.lit("")).alias("_t"))
    for g, (_, pattern) in enumerate(GENERATORS):
        df = df.withColumn(f"_p{g}", F.split("_t", pattern, -1))
        df = df.withColumn(f"_m{g}", F.when(F.size(f"_p{g}") > 1, F.regexp_extract_all("_t", F.lit(pattern), F.lit(0)))
                           .otherwise(F.array().cast("array<string>")))
    parts = []

    def item(g):
        return lambda z, i: F.struct(
            F.lit(g).alias("g"), i.alias("i"), F.length(z["p"]).cast("long").alias("gap"), z["m"].alias("match"),
            F.right(z["p"], F.lit(CONTEXT)).alias("before"), F.left(z["q"], F.lit(CONTEXT)).alias("after"))

    for g in range(len(GENERATORS)):
        p, m = F.col(f"_p{g}"), F.col(f"_m{g}")
        zipped = F.arrays_zip(F.slice(p, 1, F.size(m)).alias("p"), m.alias("m"),
                              F.slice(p, 2, F.size(m)).alias("q"))
        none = F.array().cast("array<struct<g:int,i:int,gap:bigint,match:string,before:string,after:string>>")
        parts.append(F.when(F.size(m) > 0, F.transform(zipped, item(g))).otherwise(none))
    return df.select(*keep, F.concat(*parts).alias("cands"))


def spans_of(found: DataFrame) -> DataFrame:
    """One row per proposal: row, g, kind, start, end (code points), match,
    before, after, base, good."""
    each = found.select("row", F.explode("cands").alias("c")).select("row", "c.*")
    upto = Window.partitionBy("row", "g").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    size = F.length("match").cast("long")
    each = each.withColumn("end", F.sum(F.col("gap") + size).over(upto))
    kind = F.element_at(F.array(*[F.lit(k) for k, _ in GENERATORS]), F.col("g") + 1)
    return each.select("row", "g", kind.alias("kind"), (F.col("end") - size).alias("start"), "end", "match",
                       "before", "after", (F.col("g") < BASE).alias("base"),
                       passes(F.col("g"), kind, F.col("match")).alias("good"))


def with_features(spans: DataFrame) -> tuple[DataFrame, list[str]]:
    m, d = F.col("match"), digits(F.col("match"))
    count = lambda pattern: F.length(m) - F.length(F.regexp_replace(m, pattern, ""))
    edge = lambda c, pattern: F.col(c).rlike(pattern)
    cols = {
        "f_email": F.col("kind") == "email", "f_ip": F.col("kind") == "ip", "f_card": F.col("kind") == "card",
        "f_phone": F.col("kind") == "phone", "f_len": F.length(m), "f_digits": F.length(d),
        "f_letters": count("[A-Za-z]"), "f_spaces": count(r"\x20"), "f_dots": count(r"\."), "f_dashes": count("-"),
        "f_brackets": count(r"[()]"), "f_luhn": luhn(d), "f_first": F.ascii(F.substring(d, 1, 1)),
        "f_octet": F.coalesce(F.array_max(F.transform(F.split(F.substring(m, 1, 64), "[^0-9]+"), lambda x: F.length(x))), F.lit(0)),
        "f_hint": F.col("before").rlike(HINTS), "f_joined_left": edge("before", r"[0-9A-Za-z_=\"'/#-]$"),
        "f_joined_right": edge("after", r"^[0-9A-Za-z_=\"'/#-]"), "f_stop_right": edge("after", r"^[.,;:)]|^$"),
        "f_counter": F.col("before").rlike(COUNTERS), "f_top": m.rlike(r"[\x20.\])}]" + TOP + "$"),
        "f_marked": m.rlike(r"[\[({](?:at|dot)[\])}]"), "f_dot_word": m.rlike(r"\x20dot\x20"), "f_at": m.contains("@"),
        "f_local": m.rlike(r"^[^\x20@\[({]*[0-9._+%-]"), "f_colons": count(":"),
        "f_digits_near": F.length(digits(F.concat("before", "after"))),
    }
    return (spans.select("*", *[F.coalesce(c.cast("double"), F.lit(0.0)).alias(k) for k, c in cols.items()]),
            list(cols))


def examples(seed: int = 11) -> list[tuple[str, int]]:
    """(text, label): texts in which a looser generator proposes one span;
    the label says whether it is personal data."""
    r = random.Random(seed)
    pick, digit = r.choice, lambda n: "".join(r.choice("0123456789") for _ in range(n))
    names = ["joe", "ann", "maria", "li", "omar", "kate", "peter", "sofia", "jan", "eva", "smith", "garcia", "brown", "novak"]
    words = ["site", "home", "noon", "once", "night", "work", "school", "page", "night", "last", "least", "river", "house"]
    verbs = ["arrived", "look", "stay", "meet", "was", "sold", "stood", "started", "held", "good", "laughed", "opens"]
    tops = ["com", "org", "net", "example", "edu", "de", "co.uk", "io", "info"]
    mail = ["mail me: ", "contact ", "write to ", "e-mail: ", "reach me: ", "my address is ", "send it to ", "mail "]
    call = ["call ", "phone: ", "tel. ", "mobile ", "fax ", "reach me on ", "contact: ", "ring "]
    count = ["order ", "invoice ", "ref ", "part no. ", "item ", "serial ", "isbn ", "ticket ", "case ", "batch ", "code "]
    ends = ["", ".", ", thanks", " now", " and more", "!"]
    out = []
    for _ in range(EXAMPLES):
        local = pick(names) + pick(["", "", f".{pick(names)}", digit(2), f"_{pick(names)}"])
        domain = pick(["mail", "site", "post", "corp", "example", "web"]) + pick(["", digit(1), "-x"])
        at, dot = pick([(" [at] ", " [dot] "), ("(at)", "(dot)"), (" at ", " dot "), ("{at}", "."), (" [at] ", "."), ("@ ", "."), (" @", ".")])
        out.append((pick(mail + ["see ", "so "]) + local + at + domain + "".join(
            dot + x for x in pick(tops).split(".")) + pick(ends), 1))
        stop = pick([f"{r.randint(1, 23)}.{digit(2)}", f"{pick(words)}.{pick(['Then', 'We', 'The', 'It', 'And', 'But', 'He'])}",
                     f"{pick(words)}.then", f"{pick(words)}.{pick(tops)}", f"{digit(2)}.{digit(2)}.{digit(4)}", f"{digit(1)}.{digit(1)}"])
        out.append((pick(["they ", "I ", "we ", "it ", "please ", "the mail "]) + pick(verbs) + pick([" at ", " at ", " at ", " @ "])
                    + stop + pick(ends), 0))
        six = [f"{r.randrange(1 << 16):x}" for _ in range(8)]
        short = ":".join(["2" + digit(3), *six[1:r.randint(2, 4)]]) + "::" + ":".join(six[5:r.randint(6, 8)])
        out.append((pick(["host ", "from ", "server ", "ip ", "seen at ", ""]) + pick([":".join(six), short]) + pick(ends), 1))
        a, b = pick([("add", "bad"), ("dead", "beef"), ("a", "b"), ("face", "cafe"), ("d", "ef"), ("c", "add")])
        out.append((pick(["call ", "use ", "in ", "class ", ""]) + f"{a}::{b}" + pick(ends), 0))
        sep = pick([".", "/", "_", "--", ". ", "- "])
        body = pick("3456") + digit(14)
        total = sum(sum(divmod(int(c) * (2 - i % 2), 10)) for i, c in enumerate(reversed(body)))
        card = body + str(-total % 10)
        card = sep.join(card[i:i + 4] for i in range(0, 16, 4))
        out.append((pick(["card ", "pay by visa ", "my card: ", "pay with ", "use "]) + card + pick(ends), 1))
        out.append((pick(count) + card + pick(ends), 0))
        area, rest = digit(3), f"{digit(3)}{pick('-. ')}{digit(4)}"
        out.append((pick(call) + pick([f"({area}) {rest}", f"{area}-{rest}", f"{area} {rest}", f"001 {area} {rest}"]) + pick(ends), 1))
        out.append((pick(count) + pick([f"{area}-{rest}", f"{area} {rest}", f"{area}.{rest}"]) + pick(ends), 0))
    return out


def looser(spans: DataFrame) -> DataFrame:
    """The looser spans that the trees select."""
    spark = spans.sparkSession
    told = [(2 * i + label, text) for i, (text, label) in enumerate(examples())]
    # as files: a plan that carries them costs the driver hundreds of megabytes
    given = written(spark.createDataFrame(pa.table({"row": pa.array([r for r, _ in told], pa.int64()),
                                                    "text": [t for _, t in told]})).coalesce(1), "pii-examples")
    vector = lambda df, names: VectorAssembler(inputCols=names, outputCol="features").transform(df)
    # step by step, as for the texts: one plan of all steps takes the driver's memory too
    tried = written(proposals(given, F.col("text"), ["row"]), "pii-example-proposals")
    shown, names = with_features(written(spans_of(tried), "pii-example-spans").where("NOT base AND good"))
    known = written(vector(shown, names).select(
        (F.col("row") % 2).cast("double").alias("label"), "kind", "features",
        F.pmod(F.xxhash64("row", F.lit("part")), F.lit(3)).alias("part")), "pii-train")
    model = GBTClassifier(maxIter=20, maxDepth=4, maxBins=24, seed=7, checkpointInterval=-1).fit(known.where("part <> 0"))
    score = vector_to_array(F.col("probability"))[1]
    levels = model.transform(known.where("part = 0")).groupBy("kind", F.floor(score * 50).alias("level")).agg(
        F.sum("label").alias("p"), F.count("*").alias("n")).collect()                      # <= 51 rows of each kind
    least = F.lit(2.0)
    for kind in KINDS:
        own = [r for r in levels if r.kind == kind]
        ok = [k for k in range(51) if (n := sum(r.n for r in own if r.level >= k))
              and sum(r.p for r in own if r.level >= k) >= PRECISION * n]
        # at least one half: fewer than even odds are no evidence
        least = F.when(F.col("kind") == kind, F.lit(max(25, min(ok)) / 50 if ok else 2.0)).otherwise(least)
    scored = model.transform(vector(with_features(spans.where("NOT base AND good"))[0], names)).withColumn("score", score)
    return scored.where(F.col("score") >= least).drop("features", "rawPrediction", "probability", "prediction", *names)


def selected(found: DataFrame) -> DataFrame:
    """row, kind, start, end, base of all spans: base ones that pass, looser
    ones that were selected and overlap none of them."""
    spans = written(spans_of(found), "pii-spans")
    base = spans.where("base AND good").select("row", "kind", "start", "end", F.lit(1.0).alias("score"),
                                               F.lit(True).alias("base"))
    more = looser(spans).select("row", "kind", "start", "end", "score", F.lit(False).alias("base"))
    every = base.unionByName(more)
    start = Window.partitionBy("row").orderBy("start", "end")
    before = start.rowsBetween(Window.unboundedPreceding, -1)
    behind = start.rowsBetween(1, Window.unboundedFollowing)
    only = lambda c: F.when(F.col("base"), F.col(c))
    clear = (F.coalesce(F.max(only("end")).over(before), F.lit(0)) <= F.col("start")) & (
        F.coalesce(F.min(only("start")).over(behind), F.lit(1 << 62)) >= F.col("end"))
    same = F.min(only("start")).over(Window.partitionBy("row", "start")).isNull()
    every = every.withColumn("clear", clear & same).where("base OR clear")
    # looser spans that overlap each other: the best of a chain stays
    fresh = F.col("start") >= F.coalesce(F.max(F.when(~F.col("base"), F.col("end"))).over(before), F.lit(0))
    chained = every.withColumn("chain", F.sum(F.when(~F.col("base") & fresh, 1).otherwise(0)).over(
        start.rowsBetween(Window.unboundedPreceding, 0)))
    best = Window.partitionBy("row", "base", "chain").orderBy(F.desc("score"), "start", F.desc("end"), "kind")
    return chained.withColumn("rank", F.row_number().over(best)).where("base OR rank = 1").select(
        "row", "kind", "start", "end", "base")


def listed(spans: DataFrame) -> DataFrame:
    """Per row with spans: counts by kind and both lists, of base spans and of
    all, each ordered by kind (as listed) and start."""
    place = F.array_position(F.array(*[F.lit(k) for k in KINDS]), F.col("kind"))
    item = F.struct(place.alias("k"), "start", "end", "kind")
    text = lambda c: F.array_join(F.transform(F.array_sort(c), lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")
    out = spans.groupBy("row").agg(
        *[F.sum((F.col("base") & (F.col("kind") == k)).cast("long")).alias(f"n_{k}") for k in KINDS],
        F.collect_list(F.when(F.col("base"), item)).alias("b"), F.collect_list(item).alias("a"))
    return out.select("row", *[f"n_{k}" for k in KINDS], text("b").alias("base"), text("a").alias("spans"))


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_<kind> (base spans), base, spans of every row."""
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("_text"),
                      F.monotonically_increasing_id().alias("row"))
    found = written(proposals(own, F.col("_text"), ["row", "doc_id"]), "pii-proposals")
    per = listed(selected(found))
    empty = F.lit("")
    return found.select("row", "doc_id").join(per, "row", "left").select(
        "doc_id", *[F.coalesce(f"n_{k}", F.lit(0)).cast("long").alias(f"n_{k}") for k in KINDS],
        F.coalesce("base", empty).alias("base"), F.coalesce("spans", empty).alias("spans"))


def redact(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with every selected span replaced by its kind in brackets
    (overlapping base spans as one, by the first one's kind)."""
    names = {c: f"_c{i}" for i, c in enumerate(docs.columns)}
    own = docs.select(*[docs[c].alias(k) for c, k in names.items()], F.monotonically_increasing_id().alias("row"))
    found = written(proposals(own, F.col(names[text_col]), ["row", *names.values()]), "pii-proposals")
    spans = selected(found.select("row", "cands"))
    start = Window.partitionBy("row").orderBy("start", F.desc("end"), "kind")
    before = F.max("end").over(start.rowsBetween(Window.unboundedPreceding, -1))
    chain = F.sum(F.when(F.col("start") >= F.coalesce(before, F.lit(0)), 1).otherwise(0)).over(
        start.rowsBetween(Window.unboundedPreceding, 0))
    whole = spans.withColumn("chain", chain).groupBy("row", "chain").agg(
        F.min("start").alias("start"), F.max("end").alias("end"), F.min_by("kind", F.struct("start", "kind")).alias("kind"))
    per = whole.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("start", "end", "kind"))).alias("cuts"))
    text = F.col(names[text_col])
    piece = lambda lo, hi: F.substring(text, (lo + 1).cast("int"), (hi - lo).cast("int"))
    ends = F.concat(F.array(F.lit(0).cast("long")), F.transform("cuts", lambda x: x["end"]))
    body = F.array_join(F.transform(F.arrays_zip(F.slice(ends, 1, F.size("cuts")).alias("lo"), F.col("cuts").alias("c")),
                                    lambda z: F.concat(piece(z["lo"], z["c"]["start"]),
                                                       F.concat(F.lit("["), F.upper(z["c"]["kind"]), F.lit("]")))), "")
    tail = piece(F.element_at("cuts", -1)["end"], F.length(text).cast("long"))
    done = found.drop("cands").join(per, "row", "left")
    return done.select(*[(F.when(F.col("cuts").isNotNull(), F.concat(body, tail)).otherwise(text) if c == text_col
                          else F.col(k)).alias(c) for c, k in names.items()])
