"""Date facts and rulings over orders and line items."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.functions import dates, fixed
from plumbline.operators import rulings
from plumbline.plans.registry import query


def order_texts(t):
    """One text per order with its order date and ship dates (at most seven line items)."""
    day = lambda c: F.date_format(c, "yyyy-MM-dd")
    items = F.array_sort(F.collect_list(F.struct("l_linenumber", day("l_shipdate").alias("d"))))
    shipped = t.lineitem.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(items.alias("items"))
    return t.orders.join(shipped, "o_orderkey").select("o_orderkey", F.concat(
        F.lit("Ordered on "), day("o_orderdate"), F.lit("."), F.array_join(F.transform(
            "items", lambda s: F.concat(F.lit(" Part "), s["l_linenumber"].cast("string"), F.lit(" shipped "), s["d"], F.lit("."))), "")).alias("text"))


def facts_once(rows, facts):
    """(o_orderkey, f). The facts come out of a generator, below which no filter on them is pushed to find them a second time."""
    return rows.select("o_orderkey", F.explode_outer(F.array(facts)).alias("f"))


DATED = """m AS (SELECT o_orderkey, 0 AS pos, CAST(o_orderdate AS DATE) AS d FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem)
        UNION ALL SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, CAST(l_shipdate AS DATE)), CAST(l_shipdate AS DATE) FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
    first AS (SELECT o_orderkey, d, min(pos) AS pos FROM m GROUP BY 1, 2),
    known AS (SELECT *, row_number() OVER (PARTITION BY o_orderkey ORDER BY pos) AS i FROM first),
    pairs AS (SELECT a.o_orderkey, CAST(b.d AS VARCHAR) || ' is ' || abs(b.d - a.d) || CASE WHEN abs(b.d - a.d) = 1 THEN ' day ' ELSE ' days ' END
        || CASE WHEN b.d > a.d THEN 'after ' ELSE 'before ' END || CAST(a.d AS VARCHAR) AS fact,
        row_number() OVER (PARTITION BY a.o_orderkey ORDER BY a.i, b.i) AS nth FROM known a JOIN known b ON a.o_orderkey = b.o_orderkey AND a.i < b.i)"""


@query("date_facts_native", f"WITH {DATED} SELECT o_orderkey, string_agg(fact, '; ' ORDER BY nth) AS facts, count(*) AS n FROM pairs WHERE nth <= 6 GROUP BY o_orderkey")
def date_facts_native(t):
    rows = facts_once(order_texts(t), dates.date_facts(F.col("text"), iso_only=True))
    return rows.filter(F.size("f") > 0).select("o_orderkey", F.array_join("f", "; ").alias("facts"), F.size("f").cast("bigint").alias("n"))


@query("date_facts", f"WITH {DATED} SELECT o_orderkey, string_agg(fact, '; ' ORDER BY nth) AS facts, count(*) AS n FROM pairs WHERE nth <= 6 GROUP BY o_orderkey")
def date_facts(t):
    rows = facts_once(order_texts(t), dates.date_facts(F.col("text")))
    return rows.filter(F.size("f") > 0).select("o_orderkey", F.array_join("f", "; ").alias("facts"), F.size("f").cast("bigint").alias("n"))


@query("written_date_facts", """SELECT o_orderkey, strftime(d, '%B ') || day(d) || CASE WHEN n = 0 THEN ' is the same day as ' ELSE ' is ' || abs(n) || CASE WHEN abs(n) = 1 THEN ' day' ELSE ' days' END || CASE WHEN n > 0 THEN ' after ' ELSE ' before ' END END
        || day(o) || strftime(o, ' %B %Y') AS fact
    FROM (SELECT o_orderkey, o_orderdate AS o, o_orderdate + INTERVAL 1 DAY * (o_orderkey % 60) AS moved, o_orderkey % 60 AS k,
        make_date(year(o_orderdate), month(o_orderdate + INTERVAL 1 DAY * (o_orderkey % 60)), day(o_orderdate + INTERVAL 1 DAY * (o_orderkey % 60))) AS d,
        CAST(d AS DATE) - CAST(o_orderdate AS DATE) AS n FROM orders WHERE NOT (month(o_orderdate + INTERVAL 1 DAY * (o_orderkey % 60)) = 2 AND day(o_orderdate + INTERVAL 1 DAY * (o_orderkey % 60)) = 29 AND year(o_orderdate) % 4 <> 0))""")
def written_date_facts(t):
    """A dated mention and one without a year, which takes the year of the first."""
    day = F.to_date("o_orderdate")
    later = F.date_add(day, (F.col("o_orderkey") % 60).cast("int"))
    text = F.concat(F.lit("Sent on "), dates.written(day, F.lit("dmy")), F.lit(", answered "), dates.written(later, F.lit("md")), F.lit("."))
    rows = facts_once(t.orders, dates.date_facts(text))
    return rows.select("o_orderkey", F.get("f", 0).alias("fact")).filter("fact is not null")


@query("written_dates", """SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN 1 THEN strftime(o_orderdate, '%B ') || day(o_orderdate) || strftime(o_orderdate, ', %Y')
    WHEN 2 THEN day(o_orderdate) || strftime(o_orderdate, ' %B %Y') ELSE strftime(o_orderdate, '%B ') || day(o_orderdate) END AS written FROM orders""")
def written_dates(t):
    style = F.get(F.array(*[F.lit(s) for s in ("iso", "mdy", "dmy", "md")]), (F.col("o_orderkey") % 4).cast("int"))
    return t.orders.select("o_orderkey", dates.written(F.col("o_orderdate"), style).alias("written"))


def line_cases(t):
    """Each line item is a case of every rule family: days from order to shipment."""
    days = F.datediff("l_shipdate", "o_orderdate")
    cases = t.lineitem.join(t.orders.select(F.col("o_orderkey").alias("l_orderkey"), "o_orderdate"), "l_orderkey")
    return cases.select("l_orderkey", "l_linenumber", days.alias("days"), F.explode(F.array(*[F.lit(f) for f in rulings.FAMILIES])).alias("family"))


def _sql_rulings() -> str:
    parts = []
    for family, rule in rulings.RULES.items():
        a = rule["first"][0]
        b = a + rule["add"][0]
        limits = [rulings._limit(x, a, b) for x in rule["limits"]]
        cases = " ".join(f"WHEN days <= {x} THEN '{k}'" for x, k in zip(limits, rule["rulings"]))
        parts.append(f"WHEN '{family}' THEN CASE {cases} ELSE '{rule['rulings'][-1]}' END")
    return "CASE family " + " ".join(parts) + " END"


@query("rulings", f"""WITH c AS (SELECT CAST(l_shipdate AS DATE) - CAST(o_orderdate AS DATE) AS days, unnest({rulings.FAMILIES}) AS family FROM lineitem JOIN orders ON l_orderkey = o_orderkey)
    SELECT family, {_sql_rulings()} AS ruling, count(*) AS n, CAST(min(days) AS BIGINT) AS fewest, CAST(max(days) AS BIGINT) AS most FROM c GROUP BY ALL""")
def rulings_by_family(t):
    ruled = rulings.rule(line_cases(t), rulings.policy_table(t.spark), F.col("days"))
    return ruled.groupBy("family", "ruling").agg(F.count(F.lit(1)).alias("n"), F.min("days").cast("bigint").alias("fewest"), F.max("days").cast("bigint").alias("most"))


@query("ruling_pairs", f"""WITH c AS (SELECT l_orderkey, CAST(l_shipdate AS DATE) - CAST(o_orderdate AS DATE) AS days, unnest({rulings.FAMILIES}) AS family FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
    r AS (SELECT l_orderkey, family, days, {_sql_rulings()} AS ruling FROM c)
    SELECT family, count(*) AS pairs, count(*) FILTER (differ) AS contrastive FROM (SELECT l_orderkey, family, count(DISTINCT ruling) > 1 AS differ FROM r GROUP BY ALL) GROUP BY family""")
def ruling_pairs(t):
    """Cases of one order side by side: how often the dates alone change the ruling."""
    ruled = rulings.rule(line_cases(t), rulings.policy_table(t.spark), F.col("days"))
    per = ruled.groupBy("l_orderkey", "family").agg((F.min("ruling") != F.max("ruling")).alias("differ"))
    return per.groupBy("family").agg(F.count(F.lit(1)).alias("pairs"), F.count_if("differ").alias("contrastive"))


GERMAN = ["Januar", "Februar", "März", "April", "Mai", "Juni", "Juli", "August", "September", "Oktober", "November", "Dezember"]
FRENCH = ["janvier", "février", "mars", "avril", "mai", "juin", "juillet", "août", "septembre", "octobre", "novembre", "décembre"]
SPANISH = ["enero", "febrero", "marzo", "abril", "mayo", "junio", "julio", "agosto", "septiembre", "octubre", "noviembre", "diciembre"]


@query("dates_in_languages", f"""WITH o AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d, day(o_orderdate) AS n, month(o_orderdate) AS m, year(o_orderdate) AS y FROM orders)
    SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN n || '. ' || ({GERMAN})[m] || ' ' || y WHEN 1 THEN n || ' ' || ({FRENCH})[m] || ' ' || y
        WHEN 2 THEN n || ' de ' || ({SPANISH})[m] || ' de ' || y ELSE y || '年' || m || '月' || n || '日' END AS surface, CAST(d AS VARCHAR) AS d FROM o WHERE o_orderkey % 4 <> 0 OR m NOT IN (4, 8, 9, 11)""")
def dates_in_languages(t):
    """Order dates written in German, French, Spanish and Japanese, found again in a sentence. Month names that are also
    English are known in the English forms alone, which have no dot after the day, so four German months aren't found."""
    n, m, y = F.dayofmonth("o_orderdate").cast("string"), F.month("o_orderdate"), F.year("o_orderdate").cast("string")
    name = lambda names: F.get(F.array(*[F.lit(x) for x in names]), m - 1)
    said = F.get(F.array(F.concat(F.lit("Bestellt am "), n, F.lit(". "), name(GERMAN), F.lit(" "), y, F.lit(", 3 Kisten.")),
                         F.concat(F.lit("Commande du "), n, F.lit(" "), name(FRENCH), F.lit(" "), y, F.lit(", 12 pièces.")),
                         F.concat(F.lit("Pedido el "), n, F.lit(" de "), name(SPANISH), F.lit(" de "), y, F.lit(".")),
                         F.concat(F.lit("注文日"), F.lit(" "), y, F.lit("年"), m.cast("string"), F.lit("月"), n, F.lit("日"))), (F.col("o_orderkey") % 4).cast("int"))
    found = t.orders.select("o_orderkey", F.explode(dates.find_dates(said)).alias("f"))
    return found.select("o_orderkey", "f.surface", F.col("f.date").cast("string").alias("d"))
