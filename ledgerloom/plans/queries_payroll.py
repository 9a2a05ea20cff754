"""Current state of employers and employees, and their histories."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import u256
from ..operators import decode, fold, reads
from . import sql, views
from .book import Book

BOOK = Book()
EMPLOYEE = "0x" + format(1007, "040x")
EMPLOYER = "0x" + format(3, "040x")


def _time(column: str):
    return F.date_format(column, "yyyy-MM-dd HH:mm:ss").alias(column)


# The oracle finds the deciding events by correlated position instead of by
# aggregates of order: first and last block per wallet and kind, joined back.
STAFF = sql.PAYROLL + f""",
eff AS (
  SELECT employee AS wallet, block_number AS b, event_name AS k, block_timestamp AS t, tx_hash AS x, cents,
         coalesce(employer, {sql.ZERO}) AS boss
  FROM payroll WHERE employee IS NOT NULL),
marks AS (
  SELECT wallet, min(b) AS b_first,
         min(b) FILTER (k = 'EmployeeAdded') AS b_added1,
         max(b) FILTER (k = 'EmployeeAdded') AS b_added,
         max(b) FILTER (k = 'EmployeeRemoved') AS b_removed,
         max(b) FILTER (k = 'SalaryClaimed') AS b_claimed,
         max(b) FILTER (k <> 'PayrollFunded') AS b_tx
  FROM eff GROUP BY wallet),
employees AS (
  SELECT m.wallet, coalesce(a.boss, f.boss) AS employer,
         coalesce(a.cents, 0) AS salary,
         a.cents * 2 AS allocation,
         CASE WHEN m.b_added IS NULL THEN m.b_removed IS NULL
              ELSE m.b_added > coalesce(m.b_removed, -1) END AS active,
         CASE WHEN f.k IN ('PayrollFunded', 'SalaryClaimed') THEN f.t ELSE a1.t END AS added_at,
         r.t AS removed_at, {sql.epoch('r.t')} AS deactivation_time,
         {sql.epoch('c.t')} AS last_withdraw,
         coalesce(l.x, f.x) AS latest_tx_hash
  FROM marks m JOIN eff f ON f.wallet = m.wallet AND f.b = m.b_first
  LEFT JOIN eff a ON a.wallet = m.wallet AND a.b = m.b_added
  LEFT JOIN eff a1 ON a1.wallet = m.wallet AND a1.b = m.b_added1
  LEFT JOIN eff r ON r.wallet = m.wallet AND r.b = m.b_removed
  LEFT JOIN eff c ON c.wallet = m.wallet AND c.b = m.b_claimed
  LEFT JOIN eff l ON l.wallet = m.wallet AND l.b = m.b_tx),
boss_eff AS (
  SELECT employer AS wallet, block_number AS b, event_name AS k, block_timestamp AS t, tx_hash AS x
  FROM payroll WHERE employer IS NOT NULL
  UNION ALL
  SELECT {sql.ZERO}, b, 'orphan', t, x FROM eff
  WHERE k = 'SalaryClaimed' AND b = (SELECT min(e2.b) FROM eff e2 WHERE e2.wallet = eff.wallet)),
boss_marks AS (
  SELECT wallet, min(b) AS b_first, min(b) FILTER (k = 'EmployerAdded') AS b_added1,
         max(b) FILTER (k = 'EmployerAdded') AS b_added,
         max(b) FILTER (k = 'EmployerRemoved') AS b_removed
  FROM boss_eff GROUP BY wallet),
employers AS (
  SELECT m.wallet,
         CASE WHEN m.b_added IS NULL THEN m.b_removed IS NULL
              ELSE m.b_added > coalesce(m.b_removed, -1) END AS active,
         CASE WHEN f.k NOT IN ('EmployerAdded', 'EmployerRemoved') THEN f.t ELSE a1.t END AS added_at,
         r.t AS removed_at, {sql.epoch('r.t')} AS deactivation_time,
         coalesce(l.x, f.x) AS latest_tx_hash
  FROM boss_marks m JOIN boss_eff f ON f.wallet = m.wallet AND f.b = m.b_first
  LEFT JOIN boss_eff a1 ON a1.wallet = m.wallet AND a1.b = m.b_added1
  LEFT JOIN boss_eff r ON r.wallet = m.wallet AND r.b = m.b_removed
  LEFT JOIN boss_eff l ON l.wallet = m.wallet AND l.b = greatest(m.b_added, m.b_removed))"""

EMPLOYEE_COLUMNS = f"""wallet, employer, CAST(salary AS VARCHAR) AS salary_per_second,
  CAST(allocation AS VARCHAR) AS allocation, '0' AS total_leaves, active, last_withdraw,
  deactivation_time, {sql.ts('added_at')} AS added_at, {sql.ts('removed_at')} AS removed_at,
  latest_tx_hash"""
EMPLOYER_COLUMNS = f"""wallet, '0' AS funds, '0' AS total_salary_per_second, active, deactivation_time,
  {sql.ts('added_at')} AS added_at, {sql.ts('removed_at')} AS removed_at, latest_tx_hash"""


def _employees_out(df):
    return df.select(
        "wallet", "employer",
        *[u256.to_string(F.col(c)).alias(c) for c in ("salary_per_second", "allocation", "total_leaves")],
        "active", "last_withdraw", "deactivation_time", _time("added_at"), _time("removed_at"),
        "latest_tx_hash",
    )


def _employers_out(df):
    return df.select(
        "wallet",
        *[u256.to_string(F.col(c)).alias(c) for c in ("funds", "total_salary_per_second")],
        "active", "deactivation_time", _time("added_at"), _time("removed_at"), "latest_tx_hash",
    )


@BOOK.add("employees_current", sql.cte(STAFF) + f"SELECT {EMPLOYEE_COLUMNS} FROM employees")
def employees_current(spark, sf_dir):
    return _employees_out(fold.fold_employees(views.payroll_events(spark, sf_dir)))


@BOOK.add("employers_current", sql.cte(STAFF) + f"SELECT {EMPLOYER_COLUMNS} FROM employers")
def employers_current(spark, sf_dir):
    return _employers_out(fold.fold_employers(views.payroll_events(spark, sf_dir)))


@BOOK.add("employees_from_logs", sql.cte(STAFF) + f"SELECT {EMPLOYEE_COLUMNS} FROM employees")
def employees_from_logs(spark, sf_dir):
    """Raw logs to current state in one plan: decode, then fold."""
    return _employees_out(fold.fold_employees(decode.decode_payroll(views.payroll_logs(spark, sf_dir))))


REORGED = STAFF.replace("FROM events)", "FROM events WHERE event_id % 7 <> 3)")


@BOOK.add("rebuild_employees_after_reorg", sql.cte(REORGED) + f"SELECT {EMPLOYEE_COLUMNS} FROM employees")
def rebuild_employees_after_reorg(spark, sf_dir):
    """Every seventh log was taken back: it stays in the ledger and leaves the state."""
    ledger = views.payroll_events(spark, sf_dir).withColumn("removed", F.col("block_number") % 7 == 3)
    return _employees_out(fold.rebuild(ledger)["employees"])


@BOOK.add("rebuild_employers_after_reorg", sql.cte(REORGED) + f"SELECT {EMPLOYER_COLUMNS} FROM employers")
def rebuild_employers_after_reorg(spark, sf_dir):
    ledger = views.payroll_events(spark, sf_dir).withColumn("removed", F.col("block_number") % 7 == 3)
    return _employers_out(fold.rebuild(ledger)["employers"])


@BOOK.add("fundings_history", sql.cte(sql.PAYROLL) + f"""
SELECT employer, employee, CAST(cents AS VARCHAR) AS amount_paid,
       CAST(cents // 100 AS VARCHAR) AS fee, CAST(cents - cents // 100 AS VARCHAR) AS amount_credited,
       tx_hash, block_number, {sql.ts('block_timestamp')} AS block_timestamp
FROM payroll WHERE event_name = 'PayrollFunded'""")
def fundings_history(spark, sf_dir):
    return fold.rebuild(views.payroll_events(spark, sf_dir))["payroll_fundings"].select(
        "employer", "employee",
        *[u256.to_string(F.col(c)).alias(c) for c in ("amount_paid", "fee", "amount_credited")],
        "tx_hash", "block_number", _time("block_timestamp"),
    )


@BOOK.add("claims_history", sql.cte(sql.PAYROLL) + f"""
SELECT employee, CAST(cents AS VARCHAR) AS amount, tx_hash, block_number,
       {sql.ts('block_timestamp')} AS block_timestamp
FROM payroll WHERE event_name = 'SalaryClaimed'""")
def claims_history(spark, sf_dir):
    return fold.rebuild(views.payroll_events(spark, sf_dir))["salary_claims"].select(
        "employee", u256.to_string(F.col("amount")).alias("amount"), "tx_hash", "block_number",
        _time("block_timestamp"),
    )


@BOOK.add("employer_totals", sql.cte(STAFF) + """,
rate AS (SELECT employer, sum(salary) AS s, count(*) AS n FROM employees WHERE active GROUP BY employer),
paid AS (SELECT employer, sum(cents - cents // 100) AS c FROM payroll
         WHERE event_name = 'PayrollFunded' GROUP BY employer)
SELECT employer, CAST(coalesce(s, 0) AS VARCHAR) AS salary_per_second,
       coalesce(n, 0) AS active_employees, CAST(coalesce(c, 0) AS VARCHAR) AS credited
FROM rate FULL JOIN paid USING (employer)""")
def employer_totals(spark, sf_dir):
    events = views.payroll_events(spark, sf_dir)
    out = fold.employer_totals(fold.fold_employees(events), fold.funding_rows(events))
    return out.select(
        "employer", u256.to_string(F.col("salary_per_second")).alias("salary_per_second"),
        "active_employees", u256.to_string(F.col("credited")).alias("credited"),
    )


PROFILE_SQL = f"""
SELECT e.wallet AS employer, e.active AS employer_active,
       coalesce(c.n, 0) AS active_employees, s.wallet AS employee,
       CAST(s.salary AS VARCHAR) AS salary_per_second, s.active AS employee_active,
       {sql.ts('s.added_at')} AS employee_added_at
FROM employers e
LEFT JOIN employees s ON s.employer = e.wallet
LEFT JOIN (SELECT employer, count(*) AS n FROM employees WHERE active GROUP BY employer) c
  ON c.employer = e.wallet"""


def _profile(spark, sf_dir, wallet=None):
    events = views.payroll_events(spark, sf_dir)
    out = reads.employer_profile(fold.fold_employers(events), fold.fold_employees(events), wallet)
    return out.select(
        "employer", "employer_active", "active_employees", "employee", "salary_per_second",
        "employee_active", _time("employee_added_at"),
    )


@BOOK.add("employer_profile", sql.cte(STAFF) + PROFILE_SQL)
def employer_profile(spark, sf_dir):
    return _profile(spark, sf_dir)


@BOOK.add("employer_profile_one", sql.cte(STAFF) + PROFILE_SQL + f" WHERE e.wallet = '{EMPLOYER}'")
def employer_profile_one(spark, sf_dir):
    return _profile(spark, sf_dir, EMPLOYER)


@BOOK.add("employee_newest_50", sql.cte(sql.PAYROLL) + """
SELECT kind, employee, rank, tx_hash, amount FROM (
  SELECT event_name AS kind, employee, tx_hash, CAST(cents AS VARCHAR) AS amount,
         row_number() OVER (PARTITION BY event_name, employee ORDER BY block_number DESC) AS rank
  FROM payroll WHERE event_name IN ('PayrollFunded', 'SalaryClaimed')) WHERE rank <= 50""")
def employee_newest_50(spark, sf_dir):
    events = views.payroll_events(spark, sf_dir)
    paid = reads.newest_per_employee(fold.funding_rows(events)).select(
        F.lit("PayrollFunded").alias("kind"), "employee", "rank", "tx_hash",
        u256.to_string(F.col("amount_paid")).alias("amount"),
    )
    claimed = reads.newest_per_employee(fold.claim_rows(events)).select(
        F.lit("SalaryClaimed").alias("kind"), "employee", "rank", "tx_hash",
        u256.to_string(F.col("amount")).alias("amount"),
    )
    return paid.unionByName(claimed)


@BOOK.add("employee_profile", sql.cte(STAFF) + """,
paid AS (SELECT employee, string_agg(tx_hash || ':' || cents, ',' ORDER BY block_number DESC) AS h FROM (
    SELECT *, row_number() OVER (PARTITION BY employee ORDER BY block_number DESC) AS r
    FROM payroll WHERE event_name = 'PayrollFunded') WHERE r <= 50 GROUP BY employee),
claimed AS (SELECT employee, string_agg(tx_hash || ':' || cents, ',' ORDER BY block_number DESC) AS h FROM (
    SELECT *, row_number() OVER (PARTITION BY employee ORDER BY block_number DESC) AS r
    FROM payroll WHERE event_name = 'SalaryClaimed') WHERE r <= 50 GROUP BY employee)
SELECT e.wallet, e.employer, CAST(e.salary AS VARCHAR) AS salary_per_second, e.active,
       coalesce(p.h, '') AS fundings, coalesce(c.h, '') AS claims
FROM employees e LEFT JOIN paid p ON p.employee = e.wallet LEFT JOIN claimed c ON c.employee = e.wallet""")
def employee_profile(spark, sf_dir):
    """Both nested histories rendered as text for comparison."""
    events = views.payroll_events(spark, sf_dir)
    out = reads.employee_profile(
        fold.fold_employees(events), fold.funding_rows(events), fold.claim_rows(events)
    )

    def text(column, amount):
        items = F.transform(column, lambda h: F.concat_ws(":", h["tx_hash"], h[amount]))
        return F.coalesce(F.concat_ws(",", items), F.lit(""))

    return out.select(
        "wallet", "employer", "salary_per_second", "active",
        text("funding_history", "amount_paid").alias("fundings"),
        text("claim_history", "amount").alias("claims"),
    )


@BOOK.add("employee_profile_one", sql.cte(STAFF) + f"""
SELECT e.wallet, e.employer, e.active,
       (SELECT count(*) FROM payroll WHERE event_name = 'PayrollFunded' AND employee = e.wallet) AS n_fundings,
       (SELECT count(*) FROM payroll WHERE event_name = 'SalaryClaimed' AND employee = e.wallet) AS n_claims
FROM employees e WHERE e.wallet = '{EMPLOYEE}'""")
def employee_profile_one(spark, sf_dir):
    events = views.payroll_events(spark, sf_dir)
    out = reads.employee_profile(
        fold.fold_employees(events), fold.funding_rows(events), fold.claim_rows(events), EMPLOYEE
    )
    return out.select(
        "wallet", "employer", "active",
        F.size(F.coalesce("funding_history", F.array())).alias("n_fundings"),
        F.size(F.coalesce("claim_history", F.array())).alias("n_claims"),
    )


_OTHER_CHAIN = 11155111


def _two_chains(rows):
    """The same rows on a second chain, under wallets that end in another digit."""
    other = rows.withColumns({
        "chain_id": F.lit(_OTHER_CHAIN).cast("long"), "wallet": F.concat(F.substring("wallet", 1, 41), F.lit("f")),
    })
    return rows.unionByName(other)


@BOOK.add("employees_of_chain", sql.cte(STAFF) + f"""
SELECT {_OTHER_CHAIN} AS chain_id, left(wallet, 41) || 'f' AS wallet, employer, active FROM employees""")
def employees_of_chain(spark, sf_dir):
    """Of a table that holds two chains."""
    from ..operators import filters as flt

    rows = _two_chains(fold.fold_employees(views.payroll_events(spark, sf_dir)))
    return flt.list_employees(rows, _OTHER_CHAIN).select(F.col("chain_id").cast("int").alias("chain_id"), "wallet", "employer", "active")


@BOOK.add("employers_of_chain", sql.cte(STAFF) + "SELECT wallet FROM employers")
def employers_of_chain(spark, sf_dir):
    from ..operators import filters as flt

    return flt.list_employers(_two_chains(fold.fold_employers(views.payroll_events(spark, sf_dir))), views.CHAIN).select("wallet")
