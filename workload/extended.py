"""Queries of dated references, coverage status, rolling volumes, pairs of procedures, case mix, growth and persistence, with their SQL.

The reference versions are the parts, one per part, with untidy periods: open, empty, overlapping and nested. The policy periods belong to
suppliers and the procedures on their lines.
"""

from __future__ import annotations

import datetime

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from claimspark.operators import anomaly, case_mix, categories, context, coverage_status as status, course, peer_groups as groups, together, utilization, volume
from claimspark.operators.claim_lines import lines_with_code
from claimspark.operators.dated import join_dated
from claimspark.operators.normalize import normalize_source
from workload import adapter as a, staging
from workload.sql_lines import CLAIMS, CODE, LINES

LINE_COLUMNS = ["claim_type", "source_claim_id", "procedure_code", "bene_id", "provider_id", "service_date"]
LINE_KEYS = ["bene_id", "source_claim_id", "provider_id"]


def _days_after(day: Column, days: Column) -> Column:
    return F.date_add(day, days.cast("int"))


def procedure_reference(spark: SparkSession, sf: str) -> DataFrame:
    """Versions of procedure descriptions with the days they hold."""
    number = F.col("p_partkey")
    first = _days_after(F.lit(datetime.date(1991, 6, 1)), number * 37 % 2900)
    last = _days_after(first, number * 13 % 1400 - F.when(number % 41 == 0, 5000).otherwise(0))
    return a.table(spark, sf, "part").select(
        a.procedure_code_text().alias("procedure_code"), F.col("p_name").alias("description"), F.col("p_type").alias("category"),
        F.when(number % 29 != 0, first).alias("effective_date"), F.when(number % 7 != 0, last).alias("termination_date"), number.alias("reference_row"),
    )


def claims_with_dated_reference(spark, sf):
    """Every claim line with the description version in force on its day."""
    rows = staging.lines(spark, sf).select(*LINE_COLUMNS)
    return join_dated(rows, procedure_reference(spark, sf), ["procedure_code"], "service_date", "effective_date", "termination_date", by=LINE_KEYS, order=["reference_row"])


def policy_periods(spark: SparkSession, sf: str) -> DataFrame:
    """One period for each supplier and procedure on its lines, a quarter of them listings as not covered."""
    claims = a.claim_base(spark, sf).filter(F.col("l_partkey") % 97 != 0)
    first = claims.groupBy("l_suppkey", a.procedure_code_text().alias("procedure_code")).agg(F.min(F.col("l_shipdate").cast("date")).alias("first"))
    supplier = F.col("l_suppkey")
    start = F.date_sub("first", (supplier % 10).cast("int"))
    return first.select(
        "procedure_code", (supplier % 4 != 0).alias("listed_as_covered"),
        F.when(supplier % 37 != 0, start).alias("effective_date"),
        F.when(supplier % 43 != 0, _days_after(start, supplier * 17 % 40 - F.when(supplier % 19 == 0, 50).otherwise(0))).alias("end_date"),
    )


def policy_spells(spark, sf):
    return status.policy_spells(policy_periods(spark, sf))


def coverage_status(spark, sf):
    """Every claim line with what the policies in force on its day say."""
    rows = lines_with_code(staging.lines(spark, sf)).select(*LINE_COLUMNS)
    return status.coverage_status(rows, policy_periods(spark, sf), by=LINE_KEYS)


def provider_volume(spark, sf):
    return volume.provider_volume(staging.lines(spark, sf))


def billed_together(spark, sf):
    return together.billed_together(staging.lines(spark, sf))


def _rounded(df: DataFrame, *columns: str) -> DataFrame:
    """Sums of logarithms differ in the last digits with the order of rows."""
    return df.withColumns({c: F.round(c, 9) + 0.0 for c in columns})


def diagnosis_mix(spark, sf):
    return _rounded(case_mix.diagnosis_mix(staging.lines(spark, sf)), "divergence", "over_by")


def place_mix(spark, sf):
    return _rounded(case_mix.place_mix(staging.lines(spark, sf)), "divergence", "over_by")


def procedure_growth(spark, sf):
    return course.procedure_growth(utilization.procedure_trends(staging.lines(spark, sf)))


def provider_persistence(spark, sf):
    return _rounded(course.persistence(course.monthly_differences(staging.lines(spark, sf))), "largest_difference")


def _context(spark: SparkSession, sf: str) -> DataFrame:
    return context.yearly_context(normalize_source(a.raw_beneficiaries(spark, sf), "beneficiary"))


def enrolment_spells(spark, sf):
    return context.enrolment_spells(_context(spark, sf))


def expected_volume(spark, sf):
    return _rounded(context.expected_volume(staging.lines(spark, sf), _context(spark, sf)), "expected_lines", "observed_to_expected")


PEER_LEVELS = [["procedure_code", "provider_id_type", "main_place"], ["procedure_code", "provider_id_type"], ["procedure_code"]]


def peer_groups(spark, sf):
    """Providers against peers of the same procedure, kind and main place, or of fewer of these."""
    stats = staging.provider_stats(spark, sf).select("provider_id", "provider_id_type", "procedure_code", "claim_count", "beneficiary_count")
    pairs = stats.join(groups.main_place(staging.lines(spark, sf)), "provider_id", "left")
    return groups.backed_off_peers(pairs, PEER_LEVELS)


def provider_changes(spark, sf):
    """Months at which a provider's volume of a procedure begins to change."""
    return _rounded(categories.change_points(categories.provider_months(staging.lines(spark, sf))), "up_peak", "down_peak")


def combination_mix(spark, sf):
    return _rounded(categories.combination_mix(staging.lines(spark, sf)), "divergence", "over_by")


def anomaly_categories(spark, sf):
    """Every provider's procedure with the reasons for which it stands out."""
    features = anomaly.peer_features(staging.provider_stats(spark, sf))
    rows = categories.anomaly_categories(staging.lines(spark, sf), features)
    rows = _rounded(rows, "diagnosis_divergence", "place_divergence", "combination_divergence")
    return rows.withColumn("categories", F.array_join("categories", "|"))


QUERIES = {f.__name__: f for f in (claims_with_dated_reference, policy_spells, coverage_status, provider_volume, billed_together, diagnosis_mix, place_mix, procedure_growth, provider_persistence, enrolment_spells, expected_volume, peer_groups, provider_changes, combination_mix, anomaly_categories)}

SQL_COLUMNS = "claim_type, source_claim_id, lines.procedure_code, bene_id, provider_id, lines.service_date"
FIRST = "DATE '1991-06-01' + CAST(p_partkey * 37 % 2900 AS INTEGER)"
REFERENCE = f"""ref AS (
  SELECT {CODE} AS procedure_code, p_name AS description, p_type AS category, p_partkey AS reference_row,
    CASE WHEN p_partkey % 29 <> 0 THEN {FIRST} END AS effective_date,
    CASE WHEN p_partkey % 7 <> 0 THEN {FIRST} + CAST(p_partkey * 13 % 1400 - CASE WHEN p_partkey % 41 = 0 THEN 5000 ELSE 0 END AS INTEGER) END AS termination_date
  FROM part
)"""
# The SQL spreads periods over their single days; open ends lie outside all days of service.
EARLY, LATE = "DATE '1985-01-01'", "DATE '2005-12-31'"
SPELLS = f"""periods AS (
  SELECT procedure_code, s % 4 <> 0 AS listed_as_covered, CASE WHEN s % 37 <> 0 THEN start END AS effective_date,
    CASE WHEN s % 43 <> 0 THEN start + CAST(s * 17 % 40 - CASE WHEN s % 19 = 0 THEN 50 ELSE 0 END AS INTEGER) END AS end_date
  FROM (SELECT l_suppkey AS s, {CODE} AS procedure_code, CAST(min(l_shipdate) AS DATE) - CAST(l_suppkey % 10 AS INTEGER) AS start
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey WHERE l_partkey % 97 <> 0 GROUP BY 1, 2)
), days AS (
  SELECT DISTINCT procedure_code, listed_as_covered,
    CAST(unnest(generate_series(CAST(coalesce(effective_date, {EARLY}) AS TIMESTAMP), CAST(coalesce(end_date, {LATE}) AS TIMESTAMP), INTERVAL 1 DAY)) AS DATE) AS day FROM periods
), numbered AS (
  SELECT *, day - CAST(row_number() OVER (PARTITION BY procedure_code, listed_as_covered ORDER BY day) AS INTEGER) AS spell FROM days
), merged AS (
  SELECT procedure_code, listed_as_covered, min(day) AS first_day, max(day) AS last_day FROM numbered GROUP BY procedure_code, listed_as_covered, spell
), spells AS (
  SELECT m.procedure_code, m.listed_as_covered, nullif(first_day, {EARLY}) AS effective_date, nullif(last_day, {LATE}) AS end_date, first_day, last_day,
    (SELECT count(*) FROM periods p WHERE p.procedure_code = m.procedure_code AND p.listed_as_covered = m.listed_as_covered
       AND coalesce(p.effective_date, {EARLY}) >= first_day AND coalesce(p.end_date, {LATE}) <= last_day
       AND coalesce(p.effective_date, {EARLY}) <= coalesce(p.end_date, {LATE})) AS periods
  FROM merged m
)"""




def _mix(item: str, source: str, *before: str) -> str:
    """Every provider's procedure against every item of the procedure, shares of 0 included."""
    return f"""WITH {', '.join([LINES, *before])}, own AS (
          SELECT provider_id, procedure_code, {item} AS item, count(*) AS n FROM {source} WHERE provider_id IS NOT NULL AND {item} IS NOT NULL GROUP BY 1, 2, 3
        ), pairs AS (SELECT provider_id, procedure_code, sum(n)::BIGINT AS rows, count(*) AS kinds FROM own GROUP BY 1, 2),
        items AS (SELECT procedure_code, item, sum(n)::BIGINT AS item_rows FROM own GROUP BY 1, 2),
        everything AS (SELECT procedure_code, sum(item_rows)::BIGINT AS all_rows FROM items GROUP BY 1),
        shares AS (
          SELECT provider_id, procedure_code, rows, kinds, all_rows - rows AS peer_rows, item, coalesce(n, 0) / CAST(rows AS DOUBLE) AS p,
            CASE WHEN all_rows > rows THEN (item_rows - coalesce(n, 0)) / CAST(all_rows - rows AS DOUBLE) END AS q, n IS NOT NULL AS has
          FROM pairs JOIN everything USING (procedure_code) JOIN items USING (procedure_code) LEFT JOIN own USING (provider_id, procedure_code, item)
        )
        SELECT provider_id, procedure_code, rows, kinds, peer_rows,
          CASE WHEN peer_rows > 0 THEN round(least(1.0, greatest(0.0, sum((CASE WHEN p > 0 THEN p * log2(p / ((p + q) / 2)) ELSE 0 END
            + CASE WHEN q > 0 THEN q * log2(q / ((p + q) / 2)) ELSE 0 END) / 2))), 9) + 0.0 END AS divergence,
          CASE WHEN peer_rows > 0 THEN (min({{'gap': q - p, 'item': item}}) FILTER (has)).item END AS most_over,
          CASE WHEN peer_rows > 0 THEN round(-(min({{'gap': q - p, 'item': item}}) FILTER (has)).gap, 9) + 0.0 END AS over_by
        FROM shares GROUP BY provider_id, procedure_code, rows, kinds, peer_rows"""


def _middle(values: str) -> str:
    return f"CASE WHEN len({values}) % 2 = 1 THEN {values}[len({values}) // 2 + 1] ELSE ({values}[len({values}) // 2] + {values}[len({values}) // 2 + 1]) / 2 END"


MONTH = "CAST(year(service_date) * 12 + month(service_date) - 1 AS BIGINT)"
CONTEXT = """context AS (
          SELECT DISTINCT CAST(o_custkey AS VARCHAR) AS bene_id, CAST(year(o_orderdate) AS INTEGER) AS year,
            year(o_orderdate) - year(DATE '1930-01-01' + CAST(c_custkey % 9000 AS INTEGER)) AS age, c_mktsegment AS sex FROM orders JOIN customer ON o_custkey = c_custkey
        )"""
# Other procedures on a claim, by a self-join of its codes.
BESIDE = """billed AS (
          SELECT DISTINCT claim_type || ':' || coalesce(source_claim_id, 'row' || row_number() OVER ()) AS claim, procedure_code, provider_id FROM coded
        ), beside AS (
          SELECT m.provider_id, m.procedure_code, o.procedure_code AS other_code
          FROM billed m JOIN (SELECT DISTINCT claim, procedure_code FROM billed) o ON m.claim = o.claim AND m.procedure_code <> o.procedure_code
        )"""
LIMITS = categories.Limits()


def _changes(name: str, sign: str) -> str:
    """Sum since the last reset; the month after that reset is the one after the last month with a sum of 0."""
    return f"""{name}s AS (
          SELECT *, {sign}distance - slack - least(0.0::DOUBLE, min({sign}distance - slack) OVER (PARTITION BY provider_id, procedure_code ORDER BY month)) AS s FROM grid
        ), {name} AS (
          SELECT provider_id, procedure_code, round(max(CASE WHEN spread > 0 THEN s / spread END), 9) + 0.0 AS peak,
            min(CASE WHEN spread > 0 AND s >= {LIMITS.decision}::DOUBLE * spread THEN month END) AS seen FROM {name}s GROUP BY 1, 2
        ), {name}_from AS (
          SELECT c.*, (SELECT coalesce(max(CASE WHEN g.s <= 0 THEN g.month + 1 END), min(g.first)) FROM {name}s g
            WHERE g.provider_id = c.provider_id AND g.procedure_code = c.procedure_code AND g.month <= c.seen) AS begin FROM {name} c
        )"""


def _month(number: str) -> str:
    return f"make_date({number} // 12, {number} % 12 + 1, 1)"


CHANGES = f"""WITH {LINES}, monthly AS (
          SELECT provider_id, procedure_code, {MONTH} AS month, {CLAIMS} AS claims FROM coded WHERE provider_id IS NOT NULL AND service_date IS NOT NULL GROUP BY 1, 2, 3
        ), spans AS (SELECT procedure_code, min(month) AS first, max(month) AS last FROM monthly GROUP BY 1),
        pairs AS (SELECT provider_id, procedure_code, sum(claims)::BIGINT AS total, sum(claims * claims)::BIGINT AS squares FROM monthly GROUP BY 1, 2 HAVING sum(claims) >= {LIMITS.min_claims}),
        sized AS (SELECT *, last - first + 1 AS n, sqrt(CAST((last - first + 1) * squares - total * total AS DOUBLE)) AS spread FROM pairs JOIN spans USING (procedure_code)),
        grid AS MATERIALIZED (
          SELECT g.*, n * sum(coalesce(claims, 0)) OVER (PARTITION BY g.provider_id, g.procedure_code ORDER BY g.month)::BIGINT - (g.month - first + 1) * total AS distance,
            CAST(g.month - first + 1 AS DOUBLE) * {LIMITS.slack}::DOUBLE * spread AS slack
          FROM (SELECT *, unnest(generate_series(first, last)) AS month FROM sized) g LEFT JOIN monthly USING (provider_id, procedure_code, month)
        ), {_changes('up', '')}, {_changes('down', '-')}
        SELECT z.provider_id, z.procedure_code, n AS months, total AS claims, {_month('u.begin')} AS up_from, {_month('u.seen')} AS up_seen, u.peak AS up_peak,
          {_month('d.begin')} AS down_from, {_month('d.seen')} AS down_seen, d.peak AS down_peak
        FROM sized z JOIN up_from u USING (provider_id, procedure_code) JOIN down_from d USING (provider_id, procedure_code)"""


def anomaly_categories_sql(features: str) -> str:
    mixes = {"diagnosis": _mix("diagnosis_code", "exploded"), "place": _mix("place_of_service_code", "coded"), "combination": _mix("other_code", "beside", BESIDE)}
    columns = ", ".join(f"{m}.rows AS {m}_rows, {m}.divergence AS {m}_divergence, {m}.most_over AS {m}_most_over" for m in mixes)
    joins = " ".join(f"LEFT JOIN ({sql}) {m} ON {m}.provider_id = f.provider_id AND {m}.procedure_code = f.procedure_code" for m, sql in mixes.items())
    differs = {m: f"WHEN {m}_rows >= {LIMITS.min_rows} AND {m}_divergence >= {LIMITS.divergence}" for m in mixes}
    return f"""WITH c AS ({CHANGES}), joined AS (
          SELECT f.provider_id, f.procedure_code, claim_count, provider_to_peer_ratio, peer_percentile, CASE
            WHEN up_seen IS NOT NULL AND (down_seen IS NULL OR up_seen <= down_seen) THEN 'up' WHEN down_seen IS NOT NULL THEN 'down' END AS change, up_from, down_from, {columns}
          FROM ({features}) f LEFT JOIN c ON c.provider_id = f.provider_id AND c.procedure_code = f.procedure_code {joins}
        ) SELECT * EXCLUDE (up_from, down_from), CASE change WHEN 'up' THEN up_from WHEN 'down' THEN down_from END AS change_from,
          concat_ws('|', CASE WHEN provider_to_peer_ratio >= {LIMITS.ratio} AND peer_percentile >= {LIMITS.percentile} AND claim_count >= {LIMITS.min_claims} THEN 'utilization' END,
            CASE {differs['diagnosis']} THEN 'diagnosis' END, CASE {differs['place']} THEN 'site_of_service' END,
            CASE WHEN change IS NOT NULL THEN 'trend' END, CASE {differs['combination']} THEN 'combination' END) AS categories FROM joined"""


ORACLES = {
    "provider_changes": CHANGES,
    "combination_mix": _mix("other_code", "beside", BESIDE),
    "enrolment_spells": f"""WITH {CONTEXT}, begins AS (
          SELECT bene_id, year FROM context c WHERE NOT EXISTS (SELECT 1 FROM context d WHERE d.bene_id = c.bene_id AND d.year = c.year - 1)
        ), spans AS (
          SELECT bene_id, year AS first_year, coalesce(lead(year) OVER (PARTITION BY bene_id ORDER BY year), 9999) AS next FROM begins
        ) SELECT s.bene_id, first_year, max(c.year) AS last_year, count(*) AS years
        FROM spans s JOIN context c ON c.bene_id = s.bene_id AND c.year >= first_year AND c.year < next GROUP BY 1, 2""",
    "expected_volume": f"""WITH {LINES}, {CONTEXT}, visits AS (
          SELECT provider_id, bene_id, year(service_date) AS year, count(*) AS n FROM lines WHERE provider_id IS NOT NULL AND service_date IS NOT NULL GROUP BY 1, 2, 3
        ), placed AS (SELECT v.*, age // 10 AS band, sex, c.bene_id IS NOT NULL AS found FROM visits v LEFT JOIN context c ON c.bene_id = v.bene_id AND c.year = v.year),
        rates AS (SELECT band, sex, sum(n) / CAST(count(*) AS DOUBLE) AS rate FROM placed WHERE found GROUP BY 1, 2),
        sums AS (
          SELECT provider_id, coalesce(sum(n) FILTER (found), 0)::BIGINT AS lines_seen, coalesce(sum(n) FILTER (NOT found), 0)::BIGINT AS lines_without_context,
            count(*) FILTER (found) AS person_years, coalesce(sum(rate) FILTER (found), 0.0) AS expected
          FROM placed LEFT JOIN rates USING (band, sex) GROUP BY 1
        ) SELECT provider_id, lines_seen, lines_without_context, person_years, round(expected, 9) + 0.0 AS expected_lines,
            CASE WHEN expected > 0 THEN round(lines_seen / expected, 9) + 0.0 END AS observed_to_expected FROM sums""",
    "diagnosis_mix": _mix("diagnosis_code", "exploded"),
    "place_mix": _mix("place_of_service_code", "coded"),
    "procedure_growth": f"""WITH {LINES}, seen AS (
          SELECT procedure_code, {MONTH} AS month, {CLAIMS} AS claims FROM coded WHERE service_date IS NOT NULL GROUP BY 1, 2
        ), spans AS (SELECT procedure_code, min(month) AS first, max(month) AS last FROM seen GROUP BY 1),
        grid AS (
          SELECT g.procedure_code, g.month, coalesce(claims, 0) AS claims, claims IS NULL AS empty
          FROM (SELECT procedure_code, unnest(generate_series(first, last)) AS month FROM spans) g LEFT JOIN seen USING (procedure_code, month)
        ), levels AS (
          SELECT procedure_code, count(*) AS months, count(*) FILTER (empty) AS empty_months, list_sort(list(CAST(claims AS DOUBLE))) AS v FROM grid GROUP BY 1
        ), slopes AS (
          SELECT a.procedure_code, list_sort(list((b.claims - a.claims) / CAST(b.month - a.month AS DOUBLE))) AS v
          FROM grid a JOIN grid b ON a.procedure_code = b.procedure_code AND a.month < b.month GROUP BY 1
        ), middle AS (SELECT l.procedure_code, months, empty_months, {_middle('l.v')} AS median_claims, {_middle('s.v')} AS monthly_slope
                      FROM levels l LEFT JOIN slopes s USING (procedure_code))
        SELECT procedure_code, make_date(first // 12, first % 12 + 1, 1) AS first_month, make_date(last // 12, last % 12 + 1, 1) AS last_month, months, empty_months,
          median_claims, monthly_slope, CASE WHEN median_claims > 0 THEN monthly_slope * 12 / median_claims END AS yearly_growth FROM middle JOIN spans USING (procedure_code)""",
    "provider_persistence": f"""WITH {LINES}, monthly AS (
          SELECT provider_id, procedure_code, {MONTH} AS month, {CLAIMS} AS claims FROM coded WHERE provider_id IS NOT NULL AND service_date IS NOT NULL GROUP BY 1, 2, 3
        ), peers AS (
          SELECT x.provider_id, x.procedure_code, x.month, x.claims, count(y.claims) AS n, sum(y.claims) AS total, sum(y.claims * y.claims) AS squares
          FROM monthly x LEFT JOIN monthly y ON y.procedure_code = x.procedure_code AND y.month = x.month AND y.provider_id <> x.provider_id GROUP BY ALL
        ), scored AS (
          SELECT *, CASE WHEN n > 1 AND n * squares > total * total THEN
            (claims - CAST(total AS DOUBLE) / n) / sqrt(CAST(n * squares - total * total AS DOUBLE) / (n * (n - 1))) END AS z FROM peers
        ), flagged AS (SELECT *, coalesce(z >= {course.THRESHOLD} AND claims >= {course.MIN_CLAIMS}, false) AS above FROM scored),
        runs AS (
          SELECT a.provider_id, a.procedure_code, a.month AS begin, count(*) AS length FROM flagged a JOIN flagged b
            ON a.provider_id = b.provider_id AND a.procedure_code = b.procedure_code AND a.above AND b.above AND b.month >= a.month
          WHERE NOT EXISTS (SELECT 1 FROM range(a.month, b.month + 1) m(k) WHERE NOT EXISTS (SELECT 1 FROM flagged c
            WHERE c.provider_id = a.provider_id AND c.procedure_code = a.procedure_code AND c.month = m.k AND c.above))
          GROUP BY 1, 2, 3
        ), best AS (SELECT DISTINCT ON (provider_id, procedure_code) * FROM runs ORDER BY provider_id, procedure_code, length DESC, begin)
        SELECT f.provider_id, f.procedure_code, count(*) AS months, count(z) AS months_compared, count(*) FILTER (above) AS months_above, coalesce(any_value(length), 0) AS longest_run,
          make_date(any_value(begin) // 12, any_value(begin) % 12 + 1, 1) AS run_from,
          make_date((any_value(begin) + any_value(length) - 1) // 12, (any_value(begin) + any_value(length) - 1) % 12 + 1, 1) AS run_to, round(max(z), 9) + 0.0 AS largest_difference
        FROM flagged f LEFT JOIN best USING (provider_id, procedure_code) GROUP BY 1, 2""",
    "claims_with_dated_reference": f"""WITH {LINES}, {REFERENCE}, asked AS (
          SELECT DISTINCT procedure_code, service_date FROM lines WHERE procedure_code IS NOT NULL AND service_date IS NOT NULL
        ), hits AS (
          SELECT asked.procedure_code, service_date, description, category, reference_row, effective_date, termination_date, count(*) OVER same AS versions_in_force,
            row_number() OVER (PARTITION BY asked.procedure_code, service_date ORDER BY effective_date DESC NULLS LAST, reference_row DESC) AS rank
          FROM asked JOIN ref ON ref.procedure_code = asked.procedure_code AND (effective_date IS NULL OR effective_date <= service_date)
            AND (termination_date IS NULL OR termination_date >= service_date) AND (effective_date IS NULL OR termination_date IS NULL OR effective_date <= termination_date)
          WINDOW same AS (PARTITION BY asked.procedure_code, service_date)
        ) SELECT {SQL_COLUMNS}, description, category, effective_date, termination_date, reference_row, coalesce(versions_in_force, 0) AS versions_in_force
        FROM lines LEFT JOIN hits ON hits.procedure_code = lines.procedure_code AND hits.service_date = lines.service_date AND rank = 1""",
    "policy_spells": f"WITH {SPELLS} SELECT procedure_code, listed_as_covered, effective_date, end_date, periods FROM spells",
    "coverage_status": f"""WITH {LINES}, {SPELLS}, found AS (
          SELECT {SQL_COLUMNS.replace('lines.', 'coded.')}, y.effective_date AS listed_from, y.end_date AS listed_to, y.procedure_code IS NOT NULL AS listed,
            n.effective_date AS not_covered_from, n.end_date AS not_covered_to, n.procedure_code IS NOT NULL AS not_covered
          FROM coded
          LEFT JOIN spells y ON y.listed_as_covered AND y.procedure_code = coded.procedure_code AND service_date BETWEEN y.first_day AND y.last_day
          LEFT JOIN spells n ON NOT n.listed_as_covered AND n.procedure_code = coded.procedure_code AND service_date BETWEEN n.first_day AND n.last_day
        ) SELECT * EXCLUDE (listed, not_covered), listed AND not_covered AS also_listed,
          CASE WHEN service_date IS NULL THEN '{status.NO_DAY}' WHEN not_covered THEN '{status.NOT_COVERED}' WHEN listed THEN '{status.LISTED}'
               ELSE '{status.NO_POLICY}' END AS coverage_status FROM found""",
    "provider_volume": f"""WITH {LINES}, known AS (
          SELECT *, claim_type || ':' || coalesce(source_claim_id, 'row' || row_number() OVER ()) AS claim FROM coded WHERE provider_id IS NOT NULL AND service_date IS NOT NULL
        ), asked AS (SELECT DISTINCT provider_id, procedure_code, service_date FROM known)
        SELECT d.provider_id, d.procedure_code, d.service_date, {', '.join(
            f"count(DISTINCT l.{column}) FILTER (l.service_date > d.service_date - {n}) AS {name}_{n}d"
            for name, column in (("claims", "claim"), ("beneficiaries", "bene_id")) for n in volume.WINDOWS)}
        FROM asked d JOIN known l ON l.provider_id = d.provider_id AND l.procedure_code = d.procedure_code
          AND l.service_date <= d.service_date AND l.service_date > d.service_date - 365 GROUP BY ALL""",
    "billed_together": f"""WITH {LINES}, items AS (
          SELECT DISTINCT claim_type || ':' || coalesce(source_claim_id, 'row' || row_number() OVER ()) AS claim, procedure_code AS code FROM coded
        ), counts AS (SELECT code, count(*) AS claims FROM items GROUP BY 1), everything AS (SELECT count(DISTINCT claim) AS n FROM items),
        pairs AS (SELECT x.code AS code_a, y.code AS code_b, count(*) AS claims_both FROM items x JOIN items y ON x.claim = y.claim AND x.code < y.code
                  GROUP BY 1, 2 HAVING count(*) >= 3)
        SELECT code_a, code_b, claims_both, a.claims AS claims_a, b.claims AS claims_b, CAST(claims_both AS DOUBLE) / n AS support,
          CAST(claims_both AS DOUBLE) / a.claims AS confidence_ab, CAST(claims_both AS DOUBLE) / b.claims AS confidence_ba,
          CAST(claims_both AS DOUBLE) * n / (CAST(a.claims AS DOUBLE) * b.claims) AS lift
        FROM pairs JOIN counts a ON a.code = code_a JOIN counts b ON b.code = code_b, everything""",
}
