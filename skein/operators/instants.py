"""Timestamps of mixed formats, precisions and zones to one UTC instant in milliseconds.

Every text is matched with the families of formats below; each valid reading becomes a candidate: all units
of a number, both orders of day and month, all zones of an abbreviation. Expectation-maximisation per source
over the mixture of formats and the months the instants fall into gives each reading a posterior. What is
stated of a source (its order of day and month) and what is plausible (the years, the unit by the number of
digits) are priors in it, and where only a reading against the statement is left, that the value names no
instant is a reading too. Texts share a posterior when their candidates and months are
the same, so EM runs over a table of counts whose size depends on formats, sources and months only,
never on the number of rows.
"""

from __future__ import annotations

import zoneinfo

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.runtime import Workspace

# Offsets in minutes of zone abbreviations; several where zones share one.
ABBREVIATIONS = {
    "UTC": [0], "GMT": [0], "Z": [0], "UT": [0], "WET": [0], "WEST": [60], "BST": [60], "CET": [60], "CEST": [120], "EET": [120], "EEST": [180],
    "MSK": [180], "IST": [330, 120, 60], "NPT": [345], "JST": [540], "KST": [540], "AEST": [600], "AEDT": [660], "ACST": [570], "ACDT": [630], "AWST": [480],
    "NZST": [720], "NZDT": [780], "EST": [-300], "EDT": [-240], "CST": [-360, 480], "CDT": [-300], "MST": [-420], "MDT": [-360], "PST": [-480, 480], "PDT": [-420],
    "AKST": [-540], "AKDT": [-480], "HST": [-600], "AST": [-240], "ADT": [-180], "BRT": [-180], "BRST": [-120], "ART": [-180], "SGT": [480], "HKT": [480],
}
# English month names.
MONTHS = ["jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"]

#: What is written exactly so needs no normalisation.
CANONICAL = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d+)?Z\z"

_TIME = r"(\d{1,2}):(\d{2})(?::(\d{2})(?:[.,](\d{1,9}))?)?"
_ZONE = r"\s*([Zz]|[+-]\d{2}:?\d{2}|[+-]\d{2}|[A-Za-z]{2,5})?(?:\[([A-Za-z0-9_+/-]+)\])?"
_NAME = r"(?:[A-Za-z]{3,9},?\s+)?"
# Family, pattern, replacement giving year|month|day|hour|minute|second|fraction|half of day|zone|region.
_FAMILIES = [
    ("iso", r"^(\d{4})[-/](\d{2})[-/](\d{2})[Tt ]\s*" + _TIME + _ZONE + "$", "$1|$2|$3|$4|$5|$6|$7||$8|$9"),
    ("basic", r"^(\d{4})(\d{2})(\d{2})[Tt](\d{2})(\d{2})(\d{2})(?:[.,](\d{1,9}))?" + _ZONE + "$", "$1|$2|$3|$4|$5|$6|$7||$8|$9"),
    ("dot", r"^(\d{1,2})\.(\d{1,2})\.(\d{4}),?\s+" + _TIME + _ZONE + "$", "$3|$2|$1|$4|$5|$6|$7||$8|$9"),
    ("slash", r"^(\d{1,2})/(\d{1,2})/(\d{4}),?\s+" + _TIME + r"(?:\s*([AaPp])\.?[Mm]\.?)?" + _ZONE + "$", "$3|$1|$2|$4|$5|$6|$7|$8|$9|$10"),
    ("mail", r"^" + _NAME + r"(\d{1,2})\s+([A-Za-z]{3})[a-z]*\s+(\d{4})\s+" + _TIME + _ZONE + "$", "$3|$2|$1|$4|$5|$6|$7||$8|$9"),
    ("ctime", r"^[A-Za-z]{3}\s+([A-Za-z]{3})\s+(\d{1,2})\s+" + _TIME + r"(?:\s+([A-Za-z]{3,5}))?\s+(\d{4})$", "$8|$1|$2|$3|$4|$5|$6||$7|"),
]
_NUMBER = r"^(\d{1,19})(?:\.(\d+))?$"
#: Orders of day and month stated for the sources; None lets EM choose between both without a prior.
STATED = {"slash": "mdy", "dot": "dmy"}
#: Priors against: an order other than the stated one, no instant at all where only such an order is left, a unit
#: that does not go with the number of digits, an instant outside the years 1990 to 2099.
AGAINST, NO_INSTANT, ODD_UNIT, OUTSIDE = 1e-6, 1e-3, 1e-2, 1e-6
_FROM_MS, _TO_MS = 631_152_000_000, 4_102_444_800_000
_MONTH = 2_629_746_000


def _int(c: Column) -> Column:
    return F.when(c == "", None).otherwise(c).try_cast("int")


def _local_ms(y, mo, d, h, mi, s, frac, half) -> Column:
    """Milliseconds since 1970 of a wall-clock time; null if there is no such date or time."""
    hour = F.when(half == "", h).when((h < 1) | (h > 12), None).otherwise(h % 12 + F.when(F.lower(half) == "p", 12).otherwise(0))
    last = F.when(mo.isin(4, 6, 9, 11), 30).when(mo != 2, 31).when(((y % 4 == 0) & (y % 100 != 0)) | (y % 400 == 0), 29).otherwise(28)
    ok = (y >= 1) & mo.between(1, 12) & d.between(1, last) & hour.between(0, 23) & mi.between(0, 59) & s.between(0, 59)
    ms = F.rpad(F.substring(frac, 1, 3), 3, "0").cast("int")
    days = F.unix_date(F.make_date(F.when(ok, y).otherwise(2000), F.when(ok, mo).otherwise(1), F.when(ok, d).otherwise(1)))
    return F.when(ok, days.cast("long") * 86_400_000 + hour * 3_600_000 + mi * 60_000 + s * 1000 + ms)


def _candidate(label, local: Column, offset: Column, region: Column) -> Column:
    return F.struct(F.lit(label).alias("label") if isinstance(label, str) else label.alias("label"), local.alias("local"), offset.alias("offset"), region.alias("region"))


def _once(df: DataFrame, **columns: Column) -> DataFrame:
    """Adds columns that are evaluated once, however often they are used: a generator is never inlined."""
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(k) for k, c in columns.items()]))))


def readings(df: DataFrame, value: str) -> DataFrame:
    """df with _r, the array of candidate readings of a text: label, local (ms), offset (minutes, null without zone), region.

    Null, empty and meaningless texts, impossible dates, zero and negative numbers have an empty array.
    """
    zones = sorted(zoneinfo.available_timezones())
    none = F.array().cast("array<struct<label:string,local:bigint,offset:int,region:string>>")
    df = _once(df, _t=F.regexp_replace(F.col(value), r"^\s+|\s+$", ""))
    t, parts = F.col("_t"), None
    for family, pattern, into in _FAMILIES:
        hit = F.split(F.concat(F.lit(family + "|"), F.regexp_replace(t, pattern, into)), r"\|", 11)
        parts = F.when(t.rlike(pattern), hit) if parts is None else parts.when(t.rlike(pattern), hit)
    df = _once(df, _parts=parts, _n=F.regexp_extract(t, _NUMBER, 1), _f=F.regexp_extract(t, _NUMBER, 2))
    p = F.col("_parts")
    name = p[2].rlike("^[A-Za-z]")
    digits = F.regexp_replace(p[9], "[^0-9]", "")
    df = _once(
        df,
        _family=p[0], _y=_int(p[1]), _h=_int(p[4]), _mi=_int(p[5]), _s=F.coalesce(_int(p[6]), F.lit(0)), _zone=F.upper(p[9]),
        _mo=F.when(name, F.array_position(F.array(*map(F.lit, MONTHS)), F.lower(p[2])).cast("int")).otherwise(_int(F.when(~name, p[2]))), _d=_int(p[3]),
        _region=F.when(p[10].isin(zones), p[10]), _sign=F.when(p[9].startswith("-"), -1).otherwise(1),
        _zh=_int(F.substring(digits, 1, 2)), _zm=F.coalesce(_int(F.substring(digits, 3, 2)), F.lit(0)), _named=name,
    )
    table = F.create_map(*[x for k, v in ABBREVIATIONS.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    zone, family = F.col("_zone"), F.col("_family")
    offsets = (
        F.when(zone == "", F.array(F.lit(None).cast("int")))
        .when(zone.rlike("^[+-]"), F.when((F.col("_zh") <= 18) & (F.col("_zm") <= 59), F.array(F.col("_sign") * (F.col("_zh") * 60 + F.col("_zm")))))
        .otherwise(F.try_element_at(table, zone))
    )
    at = lambda mo, d: _local_ms(F.col("_y"), mo, d, F.col("_h"), F.col("_mi"), F.col("_s"), p[7], p[8])
    df = _once(df, _offsets=F.coalesce(offsets, F.array().cast("array<int>")), _as_written=at(F.col("_mo"), F.col("_d")), _swapped=F.when(family.isin("slash", "dot") & (F.col("_d") != F.col("_mo")), at(F.col("_d"), F.col("_mo"))))
    order = lambda k, o, c: F.struct(F.lit(f"{k}_{o}").alias("l"), F.col(c).alias("t"))
    orders = F.array(F.struct(family.alias("l"), F.col("_as_written").alias("t")))
    for kind, main, other in (("slash", "mdy", "dmy"), ("dot", "dmy", "mdy")):
        orders = F.when(family == kind, F.array(order(kind, main, "_as_written"), order(kind, other, "_swapped"))).otherwise(orders)
    label = lambda o, z: F.concat(o["l"], F.when(F.size("_offsets") > 1, F.concat(F.lit(" "), zone, F.lit(" "), z.cast("string"))).otherwise(""))
    dated = F.flatten(F.transform(orders, lambda o: F.transform("_offsets", lambda z: _candidate(label(o, z), o["t"], z, F.col("_region")))))

    n, units = F.col("_n"), []
    size = F.length(n)
    for unit, scale, least, most in (("s", 3, 0, 11), ("ms", 0, 12, 14), ("us", -3, 15, 17), ("ns", -6, 18, 99)):
        if scale > 0:
            ms = F.when(size <= 15, n.try_cast("long") * 1000 + F.rpad(F.substring("_f", 1, 3), 3, "0").cast("long"))
        else:
            ms = n.try_cast("long") if not scale else F.floor(n.try_cast("decimal(20,0)") / 10**-scale).cast("long")
        units.append(_candidate(F.concat(F.lit(f"epoch_{unit}"), F.when(size.between(least, most), "").otherwise("?")), ms, F.lit(0), F.lit(None).cast("string")))
    df = _once(df, _units=F.when((n != "") & ~n.rlike("^0*$"), F.filter(F.array(*units), lambda x: x["local"] > 0)))
    found = F.when(n != "", F.coalesce("_units", none)).when(family.isNotNull(), F.filter(dated, lambda x: x["local"].isNotNull())).otherwise(none)
    return _once(df, _r=found)


def _prior(label: str, month: int, stated: dict) -> float:
    """How likely a reading is before the values of its source are seen."""
    family, _, order = label.split(" ")[0].partition("_")
    against = stated.get(family) not in (None, order) if family in ("slash", "dot") else False
    return (AGAINST if against else 1.0) * (ODD_UNIT if label.endswith("?") else 1.0) * (OUTSIDE if month < 0 else 1.0)


def _em(counts: list, stated: dict, rounds: int = 50) -> dict:
    """Posterior of each reading by (source, signature), then that of no instant; counts: rows of source, labels, months, n."""
    sources: dict = {}
    for r in counts:
        sources.setdefault(r["source"], []).append((tuple(r["labels"]), tuple(r["months"]), r["n"]))
    post = {}
    for source, rows in sources.items():
        rows = [(l, m, n, [_prior(a, b, stated) for a, b in zip(l, m)]) for l, m, n in rows]
        labels, months = {x for l, *_ in rows for x in l}, {x for _, m, *_ in rows for x in m}
        weight, when = dict.fromkeys(labels, 1 / len(labels)), dict.fromkeys(months, 1 / len(months))
        # no instant: as likely as any reading but for its prior, and only against an order that is not the stated one
        absent = [NO_INSTANT / (len(labels) * len(months)) if any(a.split(" ")[0].partition("_")[0] in ("slash", "dot") and stated.get(a.split("_")[0]) for a in l) else 0.0 for l, *_ in rows]

        def likes(row, none):
            l, m, _, p = row
            got = [weight[a] * when[b] * q for a, b, q in zip(l, m, p)]
            return got, sum(got) + none or 1.0

        for _ in range(rounds):
            got, at, total = dict.fromkeys(labels, 0.0), dict.fromkeys(months, 0.0), 0.0
            for row, none in zip(rows, absent):
                like, s = likes(row, none)
                for a, b, x in zip(row[0], row[1], like):
                    got[a] += row[2] * x / s
                    at[b] += row[2] * x / s
                total += row[2]
            new = {k: (v + 0.01) / (total + 0.01 * len(labels)) for k, v in got.items()}
            when = {k: (v + 0.01) / (total + 0.01 * len(months)) for k, v in at.items()}
            moved = max(abs(new[k] - weight[k]) for k in labels)
            weight = new
            if moved < 1e-9:
                break
        for row, none in zip(rows, absent):
            like, s = likes(row, none)
            post[source, row[0], row[1]] = [x / s for x in like] + [none / s]
    return post


def normalise(df: DataFrame, value: str, source: str, zone: str, stated: dict | None = None, certain: float = 0.9) -> DataFrame:
    """df with format, utc_ms, posterior, ambiguous for each value that names an instant; others are dropped.

    zone is the column of the zone for values without one (null or unknown: UTC). A wall-clock time that
    occurs twice is the earlier instant, a skipped one moves forward by the skip. Digits below the
    millisecond are dropped. Columns of df named like the results are replaced; null texts, empty and
    meaningless ones are dropped; repeated rows stay. ambiguous marks values whose best reading has a posterior below certain.
    """
    spark, stated = df.sparkSession, STATED if stated is None else stated
    base = readings(df.select(F.struct("*").alias("_row"), F.col(value).cast("string").alias("_v"), F.col(source).alias("_src"), F.col(zone).alias("_zn")), "_v").where("size(_r) > 0")
    zoned = F.when(F.col("_zn").isin(sorted(zoneinfo.available_timezones())), F.col("_zn")).otherwise("UTC")

    def utc(r: Column) -> Column:
        wall = F.unix_millis(F.to_utc_timestamp(F.timestamp_millis(r["local"]), F.coalesce(r["region"], zoned)))
        return F.when(r["offset"].isNotNull(), r["local"] - r["offset"].cast("long") * 60_000).otherwise(wall)

    # written once, as both EM and the result read it
    base, _ = Workspace(spark).write(base.select("_row", "_src", F.transform("_r", lambda r: F.struct(r["label"].alias("label"), utc(r).alias("ms"))).alias("_c")), "candidates")
    month = lambda x: F.when(x["ms"].between(_FROM_MS, _TO_MS - 1), F.floor(x["ms"] / _MONTH).cast("int")).otherwise(-1)
    every = base.select(F.col("_src").alias("source"), F.col("_c.label").alias("labels"), F.transform("_c", month).alias("months"))
    counts = every.groupBy("source", "labels", "months").agg(F.count("*").alias("n")).collect()  # sources x formats x months
    # values with one reading say how common its format is; only the others need a choice, or may name no instant
    best = [(s, list(l), list(m), k if k < len(l) else -1, float(p[k])) for (s, l, m), p in _em(counts, stated).items() if (k := p.index(max(p))) == len(l) or len(l) > 1]
    if not best:
        out = base.withColumn("_pick", F.lit(0)).withColumn("posterior", F.lit(1.0))
    else:
        chosen = spark.createDataFrame(best, "_s string, _l array<string>, _m array<int>, _p int, _q double")
        on = base["_src"].eqNullSafe(chosen["_s"]) & (base["_c"]["label"] == chosen["_l"]) & (F.transform(base["_c"], month) == chosen["_m"])
        # formats x sources x months: bounded by the formats, not by rows
        out = base.join(F.broadcast(chosen) if len(best) <= 50_000 else chosen, on, "left").withColumn("_pick", F.coalesce("_p", F.lit(0))).withColumn("posterior", F.coalesce("_q", F.lit(1.0)))
    out = out.where("_pick >= 0")
    got = F.element_at("_c", F.col("_pick") + 1)
    kept = [F.col("_row")[c].alias(c) for c in df.columns if c not in ("format", "utc_ms", "posterior", "ambiguous")]
    return out.select(*kept, F.regexp_replace(got["label"], r"\?$", "").alias("format"), got["ms"].alias("utc_ms"), "posterior", (F.col("posterior") < certain).alias("ambiguous"))
