"""The expected results of ``__spark_entry__.queries()`` as DuckDB SQL over the raw parquet views.

Written apart from the library: every query works record by record on the five inputs, with plain joins and COUNT
DISTINCT and none of the pre-aggregation that the library does. Only the fixed texts are shared.
"""

from __future__ import annotations

import re
from collections.abc import Mapping
from functools import partial

from clusterlens import labels as L

_TODAY = "DATE '2026-12-01'"


def _param(name: str) -> str:
    return f"(SELECT {name} FROM params)"


_WINDOW = _param("window_start")

# Defaults of the parameters that reports take, under the names that jobs pass them by.
_DEFAULTS = {
    "as_of": "2026-12-01", "lookback_days": "30", "workspace_filter": "ALL", "driver_cpu_threshold": "16", "driver_memory_gb_threshold": "64",
    "cpu_threshold": "70", "io_wait_threshold": "10", "memory_threshold": "80", "swap_threshold": "1",
    "vm_threshold_D": "5", "vm_threshold_E": "5", "vm_threshold_F": "2", "vm_threshold_L": "3", "vm_threshold_M": "2",
    "vm_threshold_N": "1", "vm_threshold_default": "5",
}


def _values(given: Mapping[str, str]) -> dict[str, str]:
    """The two steps that hold parameters."""
    p = {**_DEFAULTS, **given}
    numbers = ", ".join(f"{p[n]} AS {n}" for n in p if n.endswith("_threshold") or n == "vm_threshold_default")
    least = ", ".join(f"('{n[-1]}', {p[n]})" for n in p if re.fullmatch("vm_threshold_[A-Z]", n))
    return {
        "params": f"""
    SELECT CAST(DATE '{p["as_of"]}' - CAST({p["lookback_days"]} AS INT) AS TIMESTAMP) AS window_start,
           '{p["workspace_filter"]}' AS workspace, {numbers}""",
        "minimum": f"SELECT * FROM (VALUES {least}) AS minimum(letter, least_gen)",
    }

# Columns of reports that are stored under other names.
SHOWN_NAMES = {
    "executive_summary": ("Issue Category", "Affected Clusters", "Total DBUs", "Total Cost (USD)", "Recommendation")
}

# Inputs and intermediate steps: name -> (steps it needs, SQL).
_STEPS: dict[str, tuple[tuple[str, ...], str]] = {}


def _step(name: str, needs: str, sql: str) -> None:
    _STEPS[name] = (tuple(needs.split()), sql)


def _query(needs: str, sql: str, given: frozenset[str] = frozenset(), values: Mapping[str, str] | None = None) -> str:
    """Prefix the steps that a query needs, except those given as tables; ``values`` has the steps with parameters."""
    steps = _STEPS | {name: ((), step) for name, step in (values or _values({})).items()}
    ordered: list[str] = []

    def visit(name: str) -> None:
        if name not in ordered and name not in given:
            for other in steps[name][0]:
                visit(other)
            ordered.append(name)

    for name in needs.split():
        visit(name)
    return "WITH " + ",\n".join(f"{name} AS ({steps[name][1]})" for name in ordered) + "\n" + sql if ordered else sql


def _dbl(expression: str) -> str:
    return f"CAST({expression} AS DOUBLE)"


def _r2(expression: str) -> str:
    """Round a decimal."""
    return _dbl(f"ROUND({expression}, 2)")


def _rd(expression: str, digits: int = 2) -> str:
    """Round a double by its shortest decimal text, as Spark does."""
    return _dbl(f"ROUND(CAST(CAST({expression} AS VARCHAR) AS DECIMAL(38,20)), {digits})")


# ---- inputs -----------------------------------------------------------------------------------------------------

_step(
    "shape",
    "",
    """
    SELECT ['17.3.x-scala2.13', '16.4.x-scala2.12', '15.4.x-photon-scala2.12', '14.3.x-cpu-ml-scala2.12',
            '13.3.x-scala2.12', '12.2.x-gpu-ml-scala2.12', '15.1.x-scala2.12', '11.3.x-scala2.12',
            'custom-image'] AS runtimes,
           ['Standard_D4ds_v5', 'Standard_D16s_v3', 'Standard_DS3_v2', 'Standard_E8ds_v4', 'Standard_E32ds_v5',
            'Standard_F8s_v2', 'Standard_L8s_v2', 'Standard_M64ms', 'Standard_NC24ads_A100_v4',
            'Standard_D64ds_v5', 'm5.xlarge', 'Standard_E20_v5'] AS nodes""",
)
_step(
    "clusters",
    "shape",
    """
    SELECT 'acct-' || n_regionkey AS account_id, 'ws-' || c_nationkey AS workspace_id,
           'c-' || c_custkey AS cluster_id, c_name AS cluster_name, 'owner-' || (c_custkey % 17) AS owned_by,
           runtimes[1 + (c_custkey + shift) % 9] AS dbr_version,
           nodes[1 + (c_custkey + shift) % 12] AS driver_node_type,
           CASE WHEN c_custkey % 13 > 0 THEN nodes[1 + (c_custkey * 5 + 3 + shift) % 12] END AS worker_node_type,
           c_custkey % 9 AS worker_count, IF(c_mktsegment = 'BUILDING', 'JOB', 'UI') AS cluster_source,
           CAST(DATE '2026-12-01' - CAST(c_custkey % modulus AS INT) AS TIMESTAMP) AS change_time,
           IF(c_custkey % 11 = 0, TIMESTAMP '2026-12-01 00:00:00', NULL) AS delete_time
    FROM customer
    JOIN nation ON n_nationkey = c_nationkey
    JOIN (VALUES (0, 45, 1), (1, 20, 8), (0, 25, 10)) AS block(shift, modulus, every) ON c_custkey % every = 0
    CROSS JOIN shape""",
)
_step(
    "node_types",
    "",
    """
    SELECT * FROM (VALUES
        ('Standard_D4ds_v5', 4.0::DOUBLE, 16384::BIGINT), ('Standard_D16s_v3', 16, 65536),
        ('Standard_DS3_v2', 4, 14336), ('Standard_E8ds_v4', 8, 65536), ('Standard_E32ds_v5', 32, 262144),
        ('Standard_F8s_v2', 8, 16384), ('Standard_L8s_v2', 8, 65536), ('Standard_M64ms', 64, 1792000),
        ('Standard_NC24ads_A100_v4', 24, 225280), ('Standard_D64ds_v5', 64, 262144), ('m5.xlarge', 4, 16384),
        ('Standard_E20_v5', 20, 163840)) AS hardware(node_type, core_count, memory_mb)""",
)
_step(
    "list_prices",
    "",
    """
    SELECT sku, starts::TIMESTAMP AS starts, ends::TIMESTAMP AS ends, price::DECIMAL(18,4) AS price
    FROM (VALUES
        ('A_F', '2020-01-01', '2026-11-15', '0.15'), ('A_F', '2026-11-15', NULL, '0.22'),
        ('A_O', '2020-01-01', NULL, '0.55'), ('N_F', '2020-01-01', '2026-11-20', '0.07'),
        ('N_F', '2026-11-20', NULL, '0.10'), ('N_O', '2020-01-01', '2026-11-10', '0.30'),
        ('R_F', '2020-01-01', NULL, '0.40')) AS price_list(sku, starts, ends, price)""",
)
_step(
    "lts",
    "",
    f"""
    SELECT version, ends, CAST(date_diff('day', {_TODAY}, ends) AS DOUBLE) AS days_left
    FROM (VALUES ('17.3', DATE '2028-10-22'), ('16.4', DATE '2028-05-09'), ('15.4', DATE '2027-08-19'),
                 ('14.3', DATE '2027-02-01'), ('13.3', DATE '2026-08-22'), ('12.2', DATE '2026-03-01'))
         AS schedule(version, ends)""",
)
_step(
    "usage",
    "",
    """
    SELECT l_returnflag || '_' || l_linestatus AS sku,
           CAST(DATE '2026-12-01' - CAST((l_orderkey * 3 + l_linenumber) % 60 AS INT) AS TIMESTAMP) AS began,
           CAST(l_quantity AS DECIMAL(18,4)) AS quantity,
           CASE WHEN l_linenumber <> 7 THEN 'c-' || o_custkey END AS cluster_id
    FROM lineitem JOIN orders ON o_orderkey = l_orderkey""",
)
_step(
    "samples",
    "params",
    f"""
    SELECT 'c-' || user_id AS cluster_id, CAST(ts + INTERVAL '1035' DAY AS DATE) AS day,
           CAST(IF(user_id % 4 = 0, 65, 20) + event_id % 20 + event_id % 9 AS DOUBLE) AS cpu,
           CAST(IF(user_id % 5 = 1, 8 + event_id % 15, event_id % 4) AS DOUBLE) AS io_wait,
           CAST(IF(user_id % 7 = 2, 75 + event_id % 20, 40 + event_id % 25) AS DOUBLE) AS memory,
           CAST(IF(user_id % 9 = 3, event_id % 5, 0) AS DOUBLE) AS swap
    FROM events
    WHERE ts + INTERVAL '1035' DAY >= {_WINDOW} AND event_id % 6 <> 0""",
)

# ---- steps ------------------------------------------------------------------------------------------------------

_IN_WORKSPACE = f"({_param('workspace')} = 'ALL' OR workspace_id = {_param('workspace')})"
_step(
    "live",
    "clusters params",
    f"SELECT * FROM clusters WHERE delete_time IS NULL AND change_time >= {_WINDOW} AND {_IN_WORKSPACE}",
)
_step(
    "priced",
    "usage list_prices params",
    f"""
    SELECT usage.*, IFNULL(price, 0) AS unit_price, quantity * IFNULL(price, 0) AS cost
    FROM usage
    LEFT JOIN list_prices
           ON list_prices.sku = usage.sku AND began >= starts AND began < IFNULL(ends, TIMESTAMP '9999-01-01 00:00:00')
    WHERE began >= {_WINDOW}""",
)
_step(
    "spend",
    "priced",
    """
    SELECT cluster_id, SUM(quantity) AS dbus, SUM(cost) AS usd
    FROM priced WHERE cluster_id IS NOT NULL GROUP BY cluster_id""",
)
_step(
    "billed",
    "live spend",
    """
    SELECT live.*, IFNULL(dbus, 0) AS dbus, IFNULL(usd, 0) AS usd,
           CAST(ROUND(IFNULL(dbus, 0), 2) AS DOUBLE) AS total_dbus,
           CAST(ROUND(IFNULL(usd, 0), 2) AS DOUBLE) AS total_cost_usd
    FROM live LEFT JOIN spend USING (cluster_id)""",
)
_step(
    "supported",
    "billed lts",
    """
    SELECT billed.*, family, version AS lts_version, ends, days_left
    FROM (SELECT *, regexp_extract(dbr_version, '([0-9]+[.][0-9]+)', 1) AS family FROM billed) AS billed
    LEFT JOIN lts ON version = family""",
)
_step(
    "vm_names",
    "clusters",
    """
    SELECT name, regexp_extract(name, 'Standard_([A-Z]+)', 1) AS series,
           regexp_extract(name, '_v([0-9]+)', 1) AS gen_text,
           TRY_CAST(regexp_extract(name, '_v([0-9]+)', 1) AS INTEGER) AS gen
    FROM (SELECT driver_node_type AS name FROM clusters UNION SELECT worker_node_type FROM clusters)
    WHERE name IS NOT NULL""",
)
_LEAST = _param("vm_threshold_default")
_step(
    "vm",
    "vm_names minimum params",
    f"""
    SELECT vm_names.*, CAST(IFNULL(least_gen, {_LEAST}) AS INTEGER) AS threshold,
           gen IS NOT NULL AND gen < IFNULL(least_gen, {_LEAST}) AS old
    FROM vm_names LEFT JOIN minimum ON letter = left(series, 1)""",
)
_step(
    "aged",
    "billed vm params",
    f"""
    SELECT billed.*, d.series AS d_series, d.gen AS d_gen, d.gen_text AS d_gen_text,
           IFNULL(d.threshold, {_LEAST}) AS d_threshold, IFNULL(d.old, false) AS d_old, w.series AS w_series, w.gen AS w_gen,
           IFNULL(w.threshold, {_LEAST}) AS w_threshold, IFNULL(w.old, false) AS w_old
    FROM billed LEFT JOIN vm AS d ON d.name = driver_node_type LEFT JOIN vm AS w ON w.name = worker_node_type""",
)
_CORES, _MEMORY = _param("driver_cpu_threshold"), _param("driver_memory_gb_threshold")
_step(
    "sized",
    "billed node_types params",
    f"""
    SELECT billed.*, core_count, memory_mb, memory_mb / 1024 AS gb,
           core_count > {_CORES} OR memory_mb > {_MEMORY} * 1024 AS oversized,
           CASE WHEN core_count > {_CORES} THEN '{L.VCPUS_TOO_HIGH}' WHEN memory_mb > {_MEMORY} * 1024 THEN '{L.MEMORY_TOO_HIGH}'
                ELSE '{L.APPROPRIATELY_SIZED}' END AS sizing_status,
           CASE WHEN core_count > 32 THEN '{L.CONSIDER_E8}' WHEN core_count > 16 THEN '{L.CONSIDER_E4}'
                ELSE '{L.REVIEW_WORKLOAD}' END AS recommendation
    FROM billed JOIN node_types ON node_type = driver_node_type""",
)
_step(
    "load",
    "samples",
    """
    SELECT cluster_id, AVG(cpu) AS cpu, AVG(io_wait) AS io_wait, AVG(memory) AS memory, AVG(swap) AS swap,
           MAX(cpu) AS max_cpu, MAX(io_wait) AS max_io_wait, MAX(memory) AS max_memory, MAX(swap) AS max_swap,
           COUNT(DISTINCT day) AS days_active
    FROM samples GROUP BY cluster_id""",
)
_CPU, _IO, _MEM, _SWAP = (_param(f"{name}_threshold") for name in ("cpu", "io_wait", "memory", "swap"))
_step(
    "bottlenecks",
    "load params",
    f"""
    SELECT *, CASE WHEN memory >= {_MEM} OR swap >= {_SWAP} THEN '{L.MEMORY_BOUND}' WHEN io_wait >= {_IO} THEN '{L.IO_BOUND}'
                   WHEN cpu >= {_CPU} THEN '{L.CPU_BOUND}' ELSE '{L.BALANCED}' END AS bottleneck_type
    FROM load""",
)
_step("loaded", "billed bottlenecks", "SELECT * FROM billed JOIN bottlenecks USING (cluster_id)")

# ---- fragments --------------------------------------------------------------------------------------------------

_WHO = "account_id, workspace_id, cluster_id, cluster_name, owned_by AS owner"
_AS_TEXT = "REPLACE (CAST(change_time AS VARCHAR) AS change_time, CAST(delete_time AS VARCHAR) AS delete_time)"
_MONEY = "total_dbus, total_cost_usd"
_SUMS = f"{_r2('SUM(dbus)')} AS total_dbus, {_r2('SUM(usd)')} AS total_cost_usd"
_SHARE = _dbl("ROUND(CAST(100 * SUM(usd) / NULLIF(SUM(SUM(usd)) OVER (), 0) AS DECIMAL(18,6)), 2)")


def _status(critical: str, warning: str) -> str:
    return f"""CASE WHEN lts_version IS NULL THEN '{L.CRITICAL_NON_LTS}' WHEN days_left < 0 THEN '{L.EXPIRED}'
               WHEN days_left < 180 THEN '{critical}' WHEN days_left < 365 THEN '{warning}' ELSE '{L.SUPPORTED}' END"""


_DETAILED = _status(L.CRITICAL_SIX_MONTHS, L.WARNING_ONE_YEAR)
_SHORT = _status(L.CRITICAL, L.WARNING)
_RUNTIME_TYPE = f"""CASE WHEN dbr_version ILIKE '%ml%' THEN '{L.ML_RUNTIME}' WHEN dbr_version ILIKE '%gpu%'
                    THEN '{L.GPU_RUNTIME}' ELSE '{L.STANDARD_RUNTIME}' END"""

_FINDINGS = {
    "summary_runtime_critical": (L.RUNTIME_CRITICAL, "supported", "lts_version IS NULL OR days_left < 180"),
    "summary_runtime_warning": (L.RUNTIME_WARNING, "supported", "days_left >= 180 AND days_left <= 365"),
    "summary_old_vm": (L.OLD_VM, "aged", "d_old OR w_old"),
    "summary_oversized_driver": (L.OVERSIZED_DRIVER, "sized", "oversized"),
}


def _finding(name: str) -> str:
    (title, action), source, condition = _FINDINGS[name]
    return f"""SELECT '{title}' AS issue_category, COUNT(DISTINCT cluster_id) AS cluster_count, {_SUMS},
                      '{action}' AS recommendation
               FROM {source} WHERE {condition}"""


def all_queries(given: frozenset[str] = frozenset(), params: Mapping[str, str] | None = None) -> dict[str, str]:
    """All queries, with ``params`` in place of the default ones; inputs named in ``given`` are read from tables of that
    name and shape instead."""
    query = partial(_query, given=given, values=_values(params or {}))
    queries = {
        "workspace_ids": query("clusters", "SELECT DISTINCT workspace_id FROM clusters WHERE workspace_id IS NOT NULL ORDER BY 1"),
        "live_clusters": query("live", f"SELECT * {_AS_TEXT} FROM live"),
        "live_clusters_latest": query(
            "clusters params",
            f"""SELECT * EXCLUDE (place) {_AS_TEXT}
                FROM (SELECT *, row_number() OVER (
                          PARTITION BY cluster_id
                          ORDER BY change_time DESC, delete_time IS NOT NULL DESC, account_id DESC NULLS LAST,
                                   workspace_id DESC NULLS LAST, cluster_name DESC NULLS LAST, owned_by DESC NULLS LAST,
                                   dbr_version DESC NULLS LAST, driver_node_type DESC NULLS LAST,
                                   worker_node_type DESC NULLS LAST, worker_count DESC NULLS LAST,
                                   cluster_source DESC NULLS LAST, delete_time DESC NULLS LAST
                      ) AS place
                      FROM clusters)
                WHERE (place = 1 OR cluster_id IS NULL) AND delete_time IS NULL AND change_time >= {_WINDOW}
                      AND {_IN_WORKSPACE}""",
        ),
        "priced_usage": query(
            "priced",
            f"""SELECT cluster_id, sku AS sku_name, CAST(began AS VARCHAR) AS usage_start_time, {_dbl('quantity')} AS usage_quantity,
                       {_dbl('unit_price')} AS unit_price, {_dbl('cost')} AS cost_usd
                FROM priced""",
        ),
        "cluster_costs": query(
            "spend", f"SELECT cluster_id, {_dbl('dbus')} AS total_dbus, {_dbl('usd')} AS total_cost_usd FROM spend"
        ),
        "cluster_costs_rounded": query(
            "spend", f"SELECT cluster_id, {_r2('dbus')} AS total_dbus, {_r2('usd')} AS total_cost_usd FROM spend"
        ),
        "runtime_family": query(
            "clusters",
            """SELECT cluster_id, dbr_version, regexp_extract(dbr_version, '[0-9]+[.][0-9]+') AS runtime_family
               FROM clusters""",
        ),
        "runtime_type": query(
            "clusters", f"SELECT cluster_id, dbr_version, {_RUNTIME_TYPE} AS runtime_type FROM clusters"
        ),
        "with_support": query(
            "supported",
            """SELECT cluster_id, dbr_version, family AS runtime_family, lts_version, CAST(ends AS VARCHAR) AS end_of_support,
                      days_left AS days_until_eos
               FROM supported""",
        ),
        "support_status": query(
            "supported",
            f"""SELECT cluster_id, dbr_version, {_DETAILED} AS detailed_status, {_SHORT} AS short_status
                FROM supported""",
        ),
        "vm_series": query(
            "clusters vm",
            """SELECT cluster_id, worker_node_type, series AS vm_series
               FROM clusters LEFT JOIN vm ON name = worker_node_type""",
        ),
        "vm_generation": query(
            "clusters vm",
            """SELECT cluster_id, worker_node_type, CAST(gen AS DOUBLE) AS vm_generation
               FROM clusters LEFT JOIN vm ON name = worker_node_type""",
        ),
        "vm_threshold": query(
            "clusters vm",
            f"""SELECT cluster_id, worker_node_type, CAST(IFNULL(threshold, {_LEAST}) AS DOUBLE) AS vm_threshold
               FROM clusters LEFT JOIN vm ON name = worker_node_type""",
        ),
        "below_vm_threshold": query(
            "clusters vm",
            """SELECT cluster_id, driver_node_type, worker_node_type,
                      IFNULL(d.old, false) OR IFNULL(w.old, false) AS below_threshold
               FROM clusters LEFT JOIN vm AS d ON d.name = driver_node_type
               LEFT JOIN vm AS w ON w.name = worker_node_type""",
        ),
        "with_node_specs": query(
            "live node_types",
            f"""SELECT cluster_id, driver_node_type, d.core_count AS driver_cores, worker_node_type,
                       w.core_count AS worker_cores, {_rd('d.memory_mb / 1024', 1)} AS driver_memory_gb,
                       {_rd('w.memory_mb / 1024', 1)} AS worker_memory_gb
                FROM live JOIN node_types AS d ON d.node_type = driver_node_type
                LEFT JOIN node_types AS w ON w.node_type = worker_node_type""",
        ),
        "oversized_driver": query(
            "sized",
            "SELECT cluster_id, driver_node_type, oversized AS is_oversized, sizing_status, recommendation FROM sized",
        ),
        "worker_utilization": query(
            "load",
            "SELECT cluster_id, days_active, "
            + ", ".join(
                f"{_rd(m)} AS avg_{m}_percent, max_{m} AS max_{m}_percent" for m in ("cpu", "io_wait", "memory", "swap")
            )
            + " FROM load",
        ),
        "bottleneck_type": query("bottlenecks", "SELECT cluster_id, bottleneck_type FROM bottlenecks"),
        "share_of_total": query(
            "priced",
            f"""SELECT sku AS sku_name, {_SHARE} AS pct_of_total_cost
                FROM (SELECT sku, cost AS usd FROM priced) GROUP BY sku""",
        ),
        "outdated_runtime_detail": query(
            "supported",
            f"""SELECT {_WHO}, dbr_version, family AS dbr_family,
                       IF(lts_version IS NULL, '{L.NON_LTS}', '{L.LTS}') AS version_type,
                       CAST(ends AS VARCHAR) AS end_of_support_date, days_left AS days_until_eos,
                       {_DETAILED} AS support_status, driver_node_type, worker_node_type, cluster_source, {_MONEY}
                FROM supported""",
        ),
        "runtime_distribution": query(
            "supported",
            f"""SELECT '{L.FAMILY_PREFIX}' || family AS dbr_version,
                       IFNULL(CAST(ends AS VARCHAR), '{L.NO_END_OF_SUPPORT}') AS end_of_support_date,
                       IFNULL(days_left, 0) AS days_remaining, {_SHORT} AS status,
                       COUNT(DISTINCT cluster_id) AS cluster_count, {_SUMS}, {_SHARE} AS pct_of_total_cost
                FROM supported GROUP BY family, lts_version, ends, days_left""",
        ),
        "old_vm_detail": query(
            "aged node_types",
            f"""SELECT {_WHO}, driver_node_type, d_series AS driver_series,
                       IFNULL(CAST(d_gen AS VARCHAR), '{L.NO_GENERATION}') AS driver_vm_generation,
                       CAST(d_threshold AS DOUBLE) AS driver_min_recommended, worker_node_type, w_series AS worker_series,
                       IFNULL(CAST(w_gen AS VARCHAR), '{L.NO_GENERATION}') AS worker_vm_generation,
                       CAST(w_threshold AS DOUBLE) AS worker_min_recommended, '{L.BELOW_RECOMMENDED}' AS vm_status,
                       d.core_count AS driver_cores, {_rd('d.memory_mb / 1024', 1)} AS driver_memory_gb,
                       w.core_count AS worker_cores, {_rd('w.memory_mb / 1024', 1)} AS worker_memory_gb,
                       dbr_version, cluster_source, {_MONEY}
                FROM aged LEFT JOIN node_types AS d ON d.node_type = driver_node_type
                LEFT JOIN node_types AS w ON w.node_type = worker_node_type
                WHERE d_old OR w_old""",
        ),
        "vm_distribution": query(
            "aged",
            f"""SELECT d_series AS series, 'v' || d_gen_text AS vm_generation, 'v' || d_threshold AS min_recommended,
                       COUNT(DISTINCT cluster_id) AS cluster_count,
                       IF(bool_or(d_old), '{L.BELOW_THRESHOLD}', '{L.MEETS_THRESHOLD}') AS status,
                       {_SUMS}, {_SHARE} AS pct_of_total_cost
                FROM aged WHERE d_gen_text <> '' GROUP BY d_series, d_gen_text, d_threshold""",
        ),
        "oversized_driver_detail": query(
            "sized",
            f"""SELECT {_WHO}, driver_node_type, core_count AS driver_vcpus, {_rd('gb', 1)} AS driver_memory_gb,
                       sizing_status, worker_node_type, worker_count, dbr_version, cluster_source, {_MONEY}
                FROM sized WHERE oversized""",
        ),
        "driver_sizing_summary": query(
            "sized",
            f"""SELECT driver_node_type, core_count AS driver_vcpus, {_rd('gb', 1)} AS driver_memory_gb,
                       COUNT(DISTINCT cluster_id) AS cluster_count, {_SUMS}, {_SHARE} AS pct_of_total_cost,
                       recommendation
                FROM sized WHERE oversized GROUP BY driver_node_type, core_count, gb, recommendation""",
        ),
        "high_cpu_clusters": query(
            "loaded",
            f"""SELECT {_WHO}, dbr_version, {_RUNTIME_TYPE} AS runtime_type, {_rd('cpu')} AS avg_cpu_percent,
                       max_cpu AS max_cpu_percent, days_active, {_MONEY},
                       IF(dbr_version ILIKE '%ml%', '{L.CPU_HIGH_ML}', '{L.CPU_HIGH}') AS recommendation
                FROM loaded WHERE {_rd('cpu')} >= {_CPU}""",
        ),
        "high_io_wait_clusters": query(
            "loaded",
            f"""SELECT {_WHO}, dbr_version, {_rd('io_wait')} AS avg_io_wait_percent,
                       max_io_wait AS max_io_wait_percent, {_rd('cpu')} AS avg_cpu_percent, driver_node_type,
                       worker_node_type, {_MONEY},
                       IF({_rd('io_wait')} >= 2 * {_IO}, '{L.IO_VERY_HIGH}', '{L.IO_HIGH}') AS recommendation
                FROM loaded WHERE io_wait >= {_IO}""",
        ),
        "high_memory_clusters": query(
            "loaded",
            f"""SELECT {_WHO}, dbr_version, {_rd('memory')} AS avg_memory_percent, max_memory AS max_memory_percent,
                       {_rd('swap')} AS avg_swap_percent, max_swap AS max_swap_percent, driver_node_type,
                       worker_node_type, {_MONEY},
                       IF({_rd('swap')} >= {_SWAP}, '{L.MEMORY_SWAPPING}', '{L.MEMORY_HIGH}') AS recommendation
                FROM loaded WHERE memory >= {_MEM} OR swap >= {_SWAP}""",
        ),
        "bottleneck_summary": query(
            "loaded",
            f"""SELECT bottleneck_type,
                       MAP {{'{L.CPU_BOUND}': '{L.FIX_CPU_BOUND}', '{L.IO_BOUND}': '{L.FIX_IO_BOUND}',
                             '{L.MEMORY_BOUND}': '{L.FIX_MEMORY_BOUND}', '{L.BALANCED}': '{L.FIX_NOTHING}'}}
                           [bottleneck_type] AS recommendation,
                       COUNT(*) AS cluster_count, {_r2('SUM(usd)')} AS total_cost_usd, {_SHARE} AS pct_of_total_cost
                FROM loaded GROUP BY bottleneck_type""",
        ),
    }
    queries["overlapping_prices"] = """
        WITH quoted AS (
            SELECT IF(l_orderkey % 3 = 0, 'hot', 'P-' || l_partkey) AS sku_name, CAST(l_shipdate AS TIMESTAMP) AS starts,
                   CASE WHEN l_orderkey % 3 = 0 THEN starts + to_days(CAST(l_partkey % 3 AS INTEGER))
                        WHEN l_partkey % 50 <> 0 THEN starts + to_days(CAST(l_partkey % 40 - 1 AS INTEGER)) END AS ends
            FROM lineitem
        ),
        counted AS (
            SELECT sku_name, starts, ends, COUNT(*) AS n FROM quoted WHERE ends IS NULL OR starts < ends GROUP BY ALL
        ),
        followed AS (
            SELECT *, MAX(coalesce(ends, TIMESTAMP '9999-12-31')) OVER (
                       PARTITION BY sku_name ORDER BY starts, ends NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING
                   ) AS covered
            FROM counted
        )
        SELECT sku_name, CAST(starts AS VARCHAR) AS price_start_time, CAST(ends AS VARCHAR) AS price_end_time,
               IF(starts < covered, n, n - 1) AS n_prices
        FROM followed WHERE IF(starts < covered, n, n - 1) > 0"""
    dated = []
    for day in ("2026-12-01", "2026-12-02"):
        at_day = _values({**(params or {}), "as_of": day})
        sizing = _query(
            "sized",
            f"""SELECT driver_node_type, core_count AS driver_vcpus, {_rd('gb', 1)} AS driver_memory_gb,
                       COUNT(DISTINCT cluster_id) AS cluster_count, {_SUMS}, {_SHARE} AS pct_of_total_cost,
                       recommendation, '{day}' AS as_of
                FROM sized WHERE oversized GROUP BY driver_node_type, core_count, gb, recommendation""",
            given,
            at_day,
        )
        dated.append(f"SELECT * FROM ({sizing})")
    queries["report_history"] = " UNION ALL ".join(dated)
    queries["spend_by_group_wide"] = query(
        "billed",
        f"""SELECT dbr_version, COUNT(DISTINCT cluster_id) AS cluster_count, COUNT(*) AS record_count,
                   {_dbl('SUM(dbus)')} AS total_dbus, {_dbl('SUM(usd)')} AS total_cost_usd
            FROM billed GROUP BY dbr_version""",
    )
    for name, (_, source, _) in _FINDINGS.items():
        queries[name] = query(source, _finding(name))
    findings = " UNION ALL ".join(f"({_finding(name)})" for name in _FINDINGS)
    queries["executive_summary"] = query(
        "supported aged sized",
        f"""SELECT issue_category AS "Issue Category", cluster_count AS "Affected Clusters",
                   total_dbus AS "Total DBUs", total_cost_usd AS "Total Cost (USD)", recommendation AS "Recommendation"
            FROM ({findings})""",
    )
    return queries
