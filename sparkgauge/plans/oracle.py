"""SQL of every query for another engine, over the same tables.

Written from the definitions, independently of the DataFrame code: window functions and
ordered aggregates over whole groups, which is fine at the size the check runs at.
"""

from sparkgauge.plans import fixtures

_ORDER = ", ".join(fixtures.LOG_ORDER)


def _columns(texts: dict[str, str]) -> str:
    return ", ".join(f"{text} AS {name}" for name, text in texts.items())


# raw event fields -> tk: task columns.
_TASKS = f"""
b AS (SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, {_columns(fixtures.BASE)} FROM lineitem),
tm AS (SELECT *, launch_ms + dur_ms AS finish_ms FROM b),
raw AS (
  SELECT 'app-' || CAST(app_no AS VARCHAR) AS app_id, app_no,
         row_number() OVER (ORDER BY {_ORDER}) AS pos, l_partkey, l_suppkey, l_linenumber,
         stage_id, launch_ms, finish_ms, dur_ms, disc100, exec_no, {_columns(fixtures.RAW)}
  FROM tm
),
tk AS (
  SELECT app_id, app_no, pos, l_partkey, l_suppkey, l_linenumber, stage_id, task_id, executor_id, host, launch_ms, finish_ms,
    dur_ms, disc100, exec_no,
    finish_ms - launch_ms AS runtime_ms,
    run_ms AS executor_run_ms, deser_ms AS executor_deser_ms, ser_ms AS result_ser_ms,
    finish_ms - run_ms - deser_ms - ser_ms - launch_ms AS scheduler_delay_ms,
    gc AS gc_ms, gc_total - gc AS start_gc_total, gc_total AS end_gc_total,
    coalesce(compute_ns / 1e6, 0) AS compute_ms,
    coalesce(disk_ns / 1e6, 0) AS disk_ms,
    coalesce(spill, 0) AS disk_bytes_spilled, coalesce(spill, 0) > 0 AS spilled,
    start_tx AS start_tx_bytes, end_tx AS end_tx_bytes, tx_rate AS tx_Bps, rx_rate AS rx_Bps,
    start_idle AS start_tx_idle_ms, end_idle AS end_tx_idle_ms,
    user_util AS proc_user_cpu, sys_util AS proc_sys_cpu, user_util + sys_util AS proc_cpu,
    all_user_util + all_sys_util AS total_cpu,
    start_user_jiffies + start_sys_jiffies AS start_cpu_jiffies,
    end_user_jiffies + end_sys_jiffies AS end_cpu_jiffies,
    launch_ms AS start_cpu_sample_ms, finish_ms AS end_cpu_sample_ms,
    coalesce(hdfs_deser, 0) AS hdfs_deser_ms, coalesce(hdfs_ser, 0) AS hdfs_ser_ms,
    coalesce(sw_write_ns / 1e6, 0) + coalesce(sw_open_ns / 1e6, 0) + coalesce(sw_close_ns / 1e6, 0) AS shuffle_write_ms,
    coalesce(sw_bytes / CAST(1048576 AS DOUBLE), 0) AS shuffle_write_mb,
    coalesce(in_read_ns / 1e6, 0) AS input_read_ms,
    coalesce(in_method, 'unknown') AS input_method,
    coalesce(CASE WHEN in_method = 'Hadoop' AND in_hadoop_bytes IS NOT NULL THEN in_hadoop_bytes ELSE in_bytes END / CAST(1048576 AS DOUBLE), 0) AS input_mb,
    coalesce(out_write_ns / 1e6, 0) AS output_write_ms,
    (coalesce(out_bytes, 0) + coalesce(block_a, 0) + coalesce(block_b, 0)) / CAST(1048576 AS DOUBLE) AS output_mb,
    NOT (coalesce(block_a, 0) > 0 OR coalesce(block_b, 0) > 0) AS output_on_disk,
    (coalesce(block_a, 0) > 0 OR coalesce(block_b, 0) > 0) AND coalesce(out_bytes, 0) > 0 AS output_conflict,
    fetch_wait IS NOT NULL AS has_fetch,
    fetch_wait IS NOT NULL OR locality = 'NODE_LOCAL' AS data_local,
    fetch_wait AS fetch_wait_ms, fetch_local_blocks AS local_blocks, fetch_remote_blocks AS remote_blocks,
    fetch_remote_bytes / CAST(1048576 AS DOUBLE) AS remote_mb,
    CASE WHEN fetch_wait IS NOT NULL THEN coalesce(fetch_local_bytes, 0) / CAST(1048576 AS DOUBLE) END AS local_mb,
    CASE WHEN fetch_wait IS NOT NULL THEN coalesce(fetch_local_ns, 0) / 1e6 END AS local_read_ms
  FROM raw
)"""

_JOB_STAGES = f"""
st AS (SELECT DISTINCT {fixtures.BASE['app_no']} AS app_no, {fixtures.BASE['stage_id']} AS stage_id FROM lineitem),
js AS (
  SELECT 'app-' || CAST(app_no AS VARCHAR) AS app_id, stage_id, {fixtures.OWN_JOB} AS job_id FROM st WHERE {fixtures.OWN_STAGE}
  UNION ALL
  SELECT 'app-' || CAST(app_no AS VARCHAR), stage_id, {fixtures.OWN_JOB} + 1 FROM st WHERE {fixtures.REUSED_STAGE}
),
jobs AS (SELECT DISTINCT app_id, job_id FROM js),
ranked AS (SELECT app_id, job_id, row_number() OVER (PARTITION BY app_id ORDER BY job_id) AS job_rank FROM jobs)"""

_JOB_TASKS = f"""
jt AS (
  SELECT tk.*, js.job_id FROM tk JOIN js ON tk.app_id = js.app_id AND tk.stage_id = js.stage_id
  WHERE tk.finish_ms >= js.job_id * {fixtures.JOB_PERIOD_MS}
)"""

_STAGES = """
stages AS (
  SELECT app_id, job_id, stage_id, count(*) AS n_tasks, min(launch_ms) AS start_ms, max(finish_ms) AS finish_ms,
    max(finish_ms) - min(launch_ms) AS runtime_ms, CAST(sum(runtime_ms) AS BIGINT) AS total_task_ms,
    sum(runtime_ms) / CAST(count(*) AS DOUBLE) AS mean_task_ms, max(runtime_ms) AS max_task_ms,
    CAST(sum(CASE WHEN spilled THEN 1 ELSE 0 END) AS BIGINT) AS n_spilled,
    coalesce(sum(remote_mb + local_mb), 0) + sum(input_mb) AS input_mb,
    sum(shuffle_write_mb) AS output_mb, coalesce(sum(remote_mb), 0) AS network_mb,
    coalesce(sum(remote_mb + local_mb), 0) > 0 AS has_shuffle_read
  FROM jt GROUP BY app_id, job_id, stage_id
),
runtimes AS (
  SELECT app_id, job_id, count(*) AS n_stages, CAST(sum(n_tasks) AS BIGINT) AS n_tasks, min(start_ms) AS start_ms,
    max(finish_ms) AS finish_ms, CAST(sum(runtime_ms) AS BIGINT) AS total_stage_ms,
    max(finish_ms) - min(start_ms) AS runtime_ms
  FROM stages GROUP BY app_id, job_id
)"""

_KS = "app_id, job_id, stage_id"
_KE = "app_id, job_id, stage_id, executor_id"

_METRICS = f"""
w AS (
  SELECT {_KE},
    first(launch_ms ORDER BY launch_ms, pos) AS f_launch,
    first(start_cpu_jiffies ORDER BY launch_ms, pos) AS f_jiffies,
    first(start_tx_idle_ms ORDER BY launch_ms, pos) AS f_idle,
    first(start_tx_bytes ORDER BY launch_ms, pos) AS f_tx,
    first(start_gc_total ORDER BY launch_ms, pos) AS f_gc,
    last(finish_ms ORDER BY finish_ms, pos) AS l_finish,
    last(end_cpu_jiffies ORDER BY finish_ms, pos) AS l_jiffies,
    last(end_tx_idle_ms ORDER BY finish_ms, pos) AS l_idle,
    last(end_tx_bytes ORDER BY finish_ms, pos) AS l_tx,
    last(end_gc_total ORDER BY finish_ms, pos) AS l_gc,
    last(host ORDER BY finish_ms, pos) AS host,
    count(*) AS n_tasks, sum(hdfs_deser_ms) AS hdfs_deser_ms, sum(hdfs_ser_ms) AS hdfs_ser_ms,
    sum(compute_ms) AS compute_ms, sum(disk_ms) AS disk_ms,
    coalesce(sum(remote_mb), 0) AS network_mb, coalesce(sum(remote_mb + local_mb), 0) AS shuffle_read_mb
  FROM jt GROUP BY {_KE}
),
em AS (
  SELECT {_KE}, host, f_launch AS start_ms, l_finish AS end_ms, l_finish - f_launch AS elapsed_ms, n_tasks,
    (l_jiffies - f_jiffies) * 10 AS cpu_ms, hdfs_deser_ms, hdfs_ser_ms, l_tx - f_tx AS tx_bytes,
    l_idle - f_idle AS tx_idle_ms, l_gc - f_gc AS gc_ms, compute_ms, disk_ms, network_mb, shuffle_read_mb,
    (l_finish - f_launch) - (l_idle - f_idle) AS tx_active_ms
  FROM w
)"""


def _ratios(cpu="cpu_ms", elapsed="elapsed_ms", active="tx_active_ms", sent="tx_bytes") -> str:
    return (
        f"round({cpu} / nullif(CAST({elapsed} * 8 AS DOUBLE), 0), 6) AS cpu_utilization, "
        f"round({active} / nullif({elapsed}, 0), 6) AS tx_utilization, "
        f"round({sent} / nullif({active}, 0) * 1000, 6) AS tx_effective_Bps"
    )


def _delta(name: str, scale: int = 1) -> str:
    text = fixtures.DISK_COUNTERS[name]
    return f"{scale} * (({text.format(ms='end_ms', k='k')}) - ({text.format(ms='start_ms', k='k')}))"


_DISK_VALUES = ", ".join(f"('{name}', {k})" for name, k in fixtures.DISKS.items())
_DISKS = f"""
dk AS (SELECT * FROM (VALUES {_DISK_VALUES}) AS v(disk, k)),
ed AS (
  SELECT {_KE}, elapsed_ms, disk, {_delta('sectors_read', 512)} AS bytes_read,
    {_delta('sectors_written', 512)} AS bytes_written, {_delta('millis_reading')} AS millis_reading,
    {_delta('millis_writing')} AS millis_writing, {_delta('millis_total')} AS millis_total
  FROM em CROSS JOIN dk WHERE NOT (executor_id = '4' AND disk = 'xvdf')
),
ee AS (
  SELECT *, CASE WHEN millis_total = 0 THEN 0 ELSE (bytes_read + bytes_written) / CAST(millis_total AS DOUBLE) * 1000 END AS effective_Bps
  FROM ed
)"""


def _models(gbps: float = 0.7) -> str:
    network = f"({gbps} * 134217728.0::DOUBLE)"
    return f"""
dsum AS (
  SELECT {_KE}, sum(bytes_read + bytes_written) AS disk_bytes, sum(bytes_read) AS disk_bytes_read,
    sum(effective_Bps) AS disk_Bps, count(*) AS own_disks,
    max(CASE WHEN bytes_read + bytes_written > 0 AND effective_Bps > 0 THEN (bytes_read + bytes_written) / effective_Bps ELSE 0 END) AS slowest_disk_s
  FROM ee WHERE disk IN ('xvdb', 'xvdc', 'xvdf') GROUP BY {_KE}
),
sd AS (SELECT {_KS}, count(DISTINCT disk) AS n_disks FROM ee WHERE disk IN ('xvdb', 'xvdc', 'xvdf') GROUP BY {_KS}),
sm AS (
  SELECT em.app_id, em.job_id, em.stage_id, count(*) AS n_executors, CAST(sum(n_tasks) AS BIGINT) AS n_tasks,
    min(start_ms) AS start_ms, max(end_ms) AS finish_ms, sum(cpu_ms) AS os_cpu_ms, sum(compute_ms) AS compute_ms,
    sum(disk_ms) AS disk_ms, sum(tx_bytes) AS tx_bytes, sum(network_mb) AS network_mb,
    sum(shuffle_read_mb) AS shuffle_read_mb, sum(hdfs_deser_ms + hdfs_ser_ms) AS ser_deser_ms,
    sum(disk_bytes) AS disk_bytes, sum(disk_bytes_read) AS disk_bytes_read, sum(disk_Bps) AS disk_Bps,
    max(CASE WHEN compute_ms = 0 THEN cpu_ms ELSE compute_ms END) / CAST(8000 AS DOUBLE) AS fixed_cpu_s,
    max(tx_bytes) / {network} AS fixed_network_s, max(slowest_disk_s) AS fixed_disk_s,
    max(disk_ms / (own_disks * CAST(1000 AS DOUBLE))) AS fixed_disk_task_s
  FROM em JOIN dsum USING ({_KE}) GROUP BY em.app_id, em.job_id, em.stage_id
),
md AS (
  SELECT {_KS}, n_executors, n_tasks, n_disks, start_ms, finish_ms, finish_ms - start_ms AS runtime_ms, os_cpu_ms, compute_ms,
    tx_bytes, network_mb, shuffle_read_mb > 0 AS has_shuffle_read,
    CASE WHEN compute_ms > 0 THEN compute_ms ELSE os_cpu_ms END / CAST(n_executors * 8000 AS DOUBLE) AS ideal_cpu_s,
    tx_bytes / (n_executors * {network}) AS ideal_network_s,
    CASE WHEN disk_Bps > 0 THEN disk_bytes / (n_executors * n_disks * CAST(80000000 AS DOUBLE)) ELSE 0 END AS ideal_disk_s,
    disk_ms / (n_executors * n_disks * CAST(1000 AS DOUBLE)) AS ideal_disk_task_s,
    ser_deser_ms / CAST(n_executors * 8000 AS DOUBLE) AS ser_deser_s,
    disk_bytes_read / (n_executors * n_disks * CAST(80000000 AS DOUBLE)) AS disk_read_s,
    fixed_cpu_s, fixed_network_s, fixed_disk_s, fixed_disk_task_s,
    greatest(fixed_cpu_s, fixed_network_s, fixed_disk_s) AS fixed_s
  FROM sm JOIN sd USING ({_KS})
),
mo AS (SELECT *, greatest(ideal_cpu_s, ideal_network_s, ideal_disk_s) AS ideal_s FROM md),
mj AS (
  SELECT app_id, job_id, count(*) AS n_stages, sum(ideal_s) AS ideal_s, sum(fixed_s) AS fixed_s, sum(ideal_cpu_s) AS cpu_s,
    sum(ideal_network_s) AS network_s, sum(ideal_disk_s) AS disk_s, sum(ser_deser_s) AS ser_deser_s,
    (max(finish_ms) - min(start_ms)) / CAST(1000 AS DOUBLE) AS actual_s, sum(runtime_ms) / CAST(1000 AS DOUBLE) AS total_stage_s,
    greatest(sum(ideal_cpu_s), sum(ideal_network_s), sum(ideal_disk_s)) AS fluid_s
  FROM mo GROUP BY app_id, job_id
)"""


def _with(*parts: str, body: str) -> str:
    return "WITH " + ",".join(parts) + "\n" + body


_JT = (_TASKS, _JOB_STAGES, _JOB_TASKS)
_ST = (*_JT, _STAGES)
_EM = (*_JT, _METRICS)
_ED = (*_EM, _DISKS)
_MO = (*_ED, _models())


def _rounded(names: str) -> str:
    return ", ".join(f"round({n}, 6) AS {n}" for n in names.split())


def _summary(source: str, keys: str, value: str, percentiles=(5, 25, 50, 75, 95), minmax=True) -> str:
    columns = [f"round(quantile_cont(CAST({value} AS DOUBLE), {p / 100}), 6) AS p{p}" for p in percentiles]
    return (
        f"SELECT {keys}, count({value}) AS n, {', '.join(columns)}, "
        f"round(CAST(min({value}) AS DOUBLE), 6) AS min, round(CAST(max({value}) AS DOUBLE), 6) AS max FROM {source} GROUP BY {keys}"
    )


_WEIGHTED = (5, 25, 50, 75, 95, 99)


def _weighted(pairs: str, keys: str, rule: str, mean: str = "mean") -> tuple[str, str]:
    """CTEs over `pairs` (keys, value, weight) and the final select."""
    firsts = ", ".join(
        f"coalesce(min(CASE WHEN CAST(cum AS DOUBLE) / total > {p / 100} THEN rn END), max(rn) + 1) AS f{i}"
        for i, p in enumerate(_WEIGHTED)
    )
    picks = []
    for i, p in enumerate(_WEIGHTED):
        if rule == "standard":
            rank = f"f{i}"
        else:
            rank = f"{i} + greatest(" + ", ".join(f"f{j} - {j}" for j in range(i + 1)) + ")"
        picks.append(f"round(max(CASE WHEN rn = {rank} THEN value END), 6) AS p{p}")
    ctes = f"""
pr AS ({pairs}),
cu AS (
  SELECT *, row_number() OVER o AS rn, sum(weight) OVER o AS cum, sum(weight) OVER (PARTITION BY {keys}) AS total
  FROM pr WINDOW o AS (PARTITION BY {keys} ORDER BY value, weight ROWS UNBOUNDED PRECEDING)
),
ff AS (SELECT {keys}, {firsts} FROM cu GROUP BY {keys})"""
    body = (
        f"SELECT {keys}, count(*) AS n, {', '.join(picks)}, "
        f"round(sum(value * weight) / sum(weight), 6) AS {mean} FROM cu JOIN ff USING ({keys}) GROUP BY {keys}"
    )
    return ctes, body


_PAIRS = """
  SELECT app_id, 'cpu_utilization' AS measure, total_cpu / 8 AS value, runtime_ms AS weight FROM jt
  UNION ALL SELECT app_id, 'cpu_process_user_utilization', proc_user_cpu / 8, runtime_ms FROM jt
  UNION ALL SELECT app_id, 'cpu_process_system_utilization', proc_sys_cpu / 8, runtime_ms FROM jt
  UNION ALL SELECT app_id, 'network_utilization', rx_Bps / 125000000, runtime_ms FROM jt
  UNION ALL SELECT app_id, 'network_utilization', tx_Bps / 125000000, runtime_ms FROM jt
  UNION ALL SELECT app_id, 'network_utilization_recv', rx_Bps / 125000000, runtime_ms FROM jt
  UNION ALL SELECT app_id, 'network_utilization_fetch_only', rx_Bps / 125000000, runtime_ms FROM jt WHERE has_fetch
  UNION ALL SELECT app_id, 'network_utilization_fetch_only', tx_Bps / 125000000, runtime_ms FROM jt WHERE has_fetch
""" + "".join(
    f"""
  UNION ALL SELECT app_id, 'disk_utilization', {fixtures.DISK_RATES['utilization'].format(k=fixtures.DISKS[d])}, runtime_ms FROM jt {where}
  UNION ALL SELECT app_id, 'disk_throughput', {fixtures.DISK_RATES['read_Bps'].format(k=fixtures.DISKS[d])} + {fixtures.DISK_RATES['write_Bps'].format(k=fixtures.DISKS[d])}, runtime_ms FROM jt {where}
"""
    for d, where in (("xvdb", ""), ("xvdf", "WHERE exec_no <> 4"))
)

_FLAT_TEXT = "app_id stage_id task_id executor_id host launch_ms finish_ms runtime_ms executor_run_ms executor_deser_ms result_ser_ms scheduler_delay_ms gc_ms start_gc_total end_gc_total disk_bytes_spilled spilled start_tx_bytes end_tx_bytes start_cpu_jiffies end_cpu_jiffies start_cpu_sample_ms end_cpu_sample_ms input_method output_on_disk output_conflict has_fetch data_local fetch_wait_ms local_blocks remote_blocks"
_FLAT_DOUBLE = "compute_ms disk_ms tx_Bps rx_Bps start_tx_idle_ms end_tx_idle_ms proc_user_cpu proc_sys_cpu proc_cpu total_cpu hdfs_deser_ms hdfs_ser_ms shuffle_write_ms shuffle_write_mb input_read_ms input_mb output_write_ms output_mb remote_mb local_mb local_read_ms"


def _counter(name: str, ms: str) -> str:
    return fixtures.DISK_COUNTERS[name].format(ms=ms, k="k")


_QUERY_CASE = f"lower({fixtures.QUERY_OF_APP})"
_EXPERIMENTS = f"""
ej AS (
  SELECT app_id, job_id, {_QUERY_CASE} AS query, {fixtures.BRANCH_OF_APP} AS branch
  FROM (SELECT *, CAST(substr(app_id, 5) AS BIGINT) AS app_no FROM jobs)
)"""


def _trials(runtimes: str, warmup: int = 1, name: str = "tr") -> str:
    return f"""
{name}_k AS (
  SELECT app_id, job_id, query, branch, runtime_ms,
    row_number() OVER (PARTITION BY app_id ORDER BY job_id) AS all_rank
  FROM ej LEFT JOIN {runtimes} USING (app_id, job_id)
),
{name}_m AS (
  SELECT *, query IN ('3b', '4') AS two, all_rank - CASE WHEN query IN ('3b', '4') THEN {2 * warmup} ELSE {warmup} END AS trial_rank FROM {name}_k
),
{name} AS (
  SELECT app_id, query, branch, trial_rank AS trial, runtime_ms, true AS complete
  FROM {name}_m WHERE NOT two AND trial_rank > 0 AND runtime_ms IS NOT NULL
  UNION ALL
  SELECT app_id, query, branch, CAST(floor((trial_rank - 1) / 2) AS BIGINT), sum(runtime_ms), count(*) = 2
  FROM {name}_m WHERE two AND trial_rank > 0 AND runtime_ms IS NOT NULL GROUP BY ALL
)"""


def _lines(trials: str, keys: str) -> str:
    return f"""
  SELECT {keys}, count(*) AS n, quantile_cont(CAST(runtime_ms AS DOUBLE), 0.5) / 1000 AS median_s,
    min(runtime_ms) / CAST(1000 AS DOUBLE) AS min_s, max(runtime_ms) / CAST(1000 AS DOUBLE) AS max_s,
    CAST(dense_rank() OVER (ORDER BY query) - 1 AS BIGINT) AS x,
    CAST(sum(CASE WHEN complete THEN 0 ELSE 1 END) AS BIGINT) AS incomplete_trials
  FROM {trials} GROUP BY {keys}"""


def _min_med_max(value: str, name: str, scale: str = "") -> str:
    v = f"CAST({value} AS DOUBLE)"
    return (
        f"round(min({v}){scale}, 6) AS {name.format('min')}, "
        f"round(quantile_cont({v}, 0.5){scale}, 6) AS {name.format('med')}, "
        f"round(max({v}){scale}, 6) AS {name.format('max')}"
    )


_SECOND_SHUFFLE = """
sj AS (SELECT DISTINCT app_id, job_id FROM stages WHERE has_shuffle_read),
sr AS (SELECT app_id, job_id, row_number() OVER (PARTITION BY app_id ORDER BY job_id) AS k FROM sj),
fr AS (SELECT ranked.app_id, job_rank AS first_rank FROM ranked JOIN sr USING (app_id, job_id) WHERE k = 2),
kept AS (
  SELECT ranked.* FROM ranked JOIN fr USING (app_id)
  WHERE job_rank >= first_rank AND (job_rank - first_rank) % 2 = 0
)"""

_SWEEP_ROWS = """
kj AS (SELECT app_id, job_id FROM ranked WHERE job_rank - 1 >= 3 AND (job_rank - 1 - 3) % 2 = 0),
ks AS (SELECT mo.* FROM mo JOIN kj USING (app_id, job_id)),
kb AS (SELECT app_id, job_id, sum(ideal_s) * 1000 AS ideal, CAST(max(finish_ms) - min(start_ms) AS DOUBLE) AS actual FROM ks GROUP BY app_id, job_id),
rows_ AS (
  SELECT app_id, actual, ideal, actual / ideal AS ratio, NULL AS map_actual, NULL AS map_ideal, NULL AS reduce_actual, NULL AS reduce_ideal FROM kb
  UNION ALL
  SELECT app_id, NULL, NULL, NULL, CASE WHEN NOT has_shuffle_read THEN runtime_ms END, CASE WHEN NOT has_shuffle_read THEN ideal_s * 1000 END,
    CASE WHEN has_shuffle_read THEN runtime_ms END, CASE WHEN has_shuffle_read THEN ideal_s * 1000 END FROM ks
),
nt AS (SELECT app_id, first(n_tasks ORDER BY job_id, stage_id) AS num_tasks FROM ks GROUP BY app_id)"""
_SWEEP_VALUES = ["actual", "ideal", "ratio", "map_actual", "map_ideal", "reduce_actual", "reduce_ideal"]

# --- monitor -------------------------------------------------------------------------------

_MONITOR = f"""
ev AS (
  SELECT event_id, user_id, event_type, value, CAST(floor(epoch_us(ts) / CAST(1000 AS DOUBLE)) AS BIGINT) AS time_ms,
    CAST(json_extract_string(props, '$.k') AS BIGINT) AS k
  FROM events
),
tick AS (SELECT event_id, time_ms, k, {_columns(fixtures.MONITOR)} FROM ev),
rel AS (SELECT *, time_ms - min(time_ms) OVER (PARTITION BY host) AS time FROM tick),
fin AS (SELECT * FROM rel WHERE NOT isnan(rx) AND NOT isinf(rx) AND NOT isnan(tx) AND NOT isinf(tx) AND NOT isnan(cpu_user + cpu_sys) AND NOT isinf(cpu_user + cpu_sys)),
ms AS (
  SELECT host, event_id, time, (cpu_user + cpu_sys) / 8 AS cpu_utilization, cpu_sys / 8 AS cpu_system,
    rx / 134217728 AS bytes_received, tx / 134217728 AS bytes_transmitted, coalesce(compute, 0) AS running_compute,
    running AS running_tasks, CAST(0 AS BIGINT) AS local_running_tasks, CAST(0 AS BIGINT) AS tasks_in_network,
    CAST(0 AS BIGINT) AS tasks_in_compute, CAST(0 AS BIGINT) AS tasks_in_disk, CAST(0 AS BIGINT) AS low_priority_network,
    coalesce(gc_part, 0) AS gc_fraction, outstanding // 1048576 AS outstanding_network_mb,
    free_heap / CAST(1073741824 AS DOUBLE) AS free_heap_gib, coalesce(free_off_heap, 0) / CAST(1073741824 AS DOUBLE) AS free_off_heap_gib,
    coalesce(total_started, 0) AS total_started, total_started IS NOT NULL AS has_total_started
  FROM fin
),
md_ AS (
  SELECT host, event_id, time, disk, cpu_user * f AS utilization, k * CAST(1000 AS DOUBLE) * f AS read_Bps, k * CAST(500 AS DOUBLE) * f AS write_Bps,
    CASE WHEN q AND k % 2 = 0 THEN k % 6 + f ELSE 0 END AS running,
    CASE WHEN q AND k % 2 = 0 THEN k % 4 ELSE 0 END AS queued_reads,
    CASE WHEN q AND k % 2 = 0 THEN k % 3 ELSE 0 END AS queued_removes,
    CASE WHEN q AND k % 2 = 0 THEN k % 5 ELSE 0 END AS queued_writes
  FROM fin CROSS JOIN (VALUES ('xvdb', 3, true), ('sda1', 2, false)) AS v(disk, f, q)
)"""

_PANEL_ROWS = []
for _panel, _names in (
    ("memory", "free_heap_gib free_off_heap_gib"),
    ("tasks", "local_running_tasks tasks_in_network tasks_in_compute tasks_in_disk running_tasks gc_fraction*8 outstanding_network_mb"),
    ("utilization", "cpu_utilization bytes_received bytes_transmitted cpu_system gc_fraction"),
):
    for _name in _names.split():
        _PANEL_ROWS.append(
            f"SELECT host, '{_panel}' AS panel, '{_name.split('*')[0]}' AS metric, CAST(NULL AS VARCHAR) AS disk, CAST({_name} AS DOUBLE) AS value FROM ms"
        )
for _panel, _names in (
    ("disk", "utilization write_Bps read_Bps"),
    ("one_disk", "running write_Bps read_Bps utilization"),
    ("utilization", "utilization"),
):
    for _name in _names.split():
        _PANEL_ROWS.append(f"SELECT host, '{_panel}', '{_name}', disk, CAST({_name} AS DOUBLE) FROM md_")

_DELTAS = """
dl AS (
  SELECT host, event_id, time, total_started - greatest(0, coalesce(max(total_started) OVER (
    PARTITION BY host ORDER BY time, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS delta
  FROM ms WHERE has_total_started
)"""

_WORK = """
ln AS (
  SELECT 'work-' || CAST(user_id % 3 AS VARCHAR) AS file, event_id AS pos,
    CASE WHEN event_type = 'error' THEN 1 WHEN event_type IN ('view', 'click') THEN 2 END AS kind,
    1 + CAST(floor(event_id / CAST(40 AS DOUBLE)) AS BIGINT) % 3 AS owner, k AS runtime_ms, time_ms AS start_ms
  FROM ev
),
pl AS (
  SELECT file, pos, kind, CASE WHEN kind = 2 THEN pos ELSE owner END AS id, CASE WHEN kind = 2 THEN owner END AS stage_id, start_ms, runtime_ms
  FROM ln
),
pv AS (
  SELECT *, last_value(stage_id IGNORE NULLS) OVER (PARTITION BY file ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev
  FROM pl WHERE kind IS NOT NULL
),
il AS (
  SELECT *, CAST(sum(CASE WHEN stage_id IS NOT NULL AND stage_id <> coalesce(prev, 0) THEN 1 ELSE 0 END) OVER (PARTITION BY file ORDER BY pos ROWS UNBOUNDED PRECEDING) AS BIGINT) AS island
  FROM pv
),
f0 AS (SELECT file, first(start_ms ORDER BY pos) AS first_start FROM pl GROUP BY file),
wl AS (
  SELECT file, island, row_number() OVER (PARTITION BY file, island ORDER BY start_ms, pos) - 1 AS lane, kind, id, start_ms - first_start AS start, runtime_ms
  FROM il JOIN f0 USING (file)
)"""
_EV = _MONITOR.split("tick AS")[0].rstrip().rstrip(",")

_TREE = """
tree AS (
  SELECT DISTINCT 'q' || CAST(o_custkey % 997 AS VARCHAR) AS query,
    CASE o_orderkey % 3 WHEN 0 THEN 'left' WHEN 1 THEN 'right' ELSE 'extra' END AS branch
  FROM orders
)"""


# Queries compared at nine digits.
_FINE = """
m1_m4_ideal_stage m3b_m5b_ideal_from_disk_times m5_ideal_stage_fixed m6_m7_ser_and_disk_read
m8_m9_ideal_job m10_what_if_in_memory g3_sort_phases g4_k8_task_sweep p23_sweep_plot_columns
g6_estimate_report g9_p20_monitor_samples
""".split()


_ODD_LINE = """CASE WHEN (l_partkey + l_suppkey) % 29 = 0 THEN 'broken'
  WHEN (l_partkey + l_suppkey) % 17 = 0 OR (l_partkey + l_suppkey) % 19 = 0 OR (l_partkey + l_suppkey) % 23 = 0 THEN 'odd'
  WHEN (l_partkey + l_suppkey) % 7 = 0 THEN 'other'
  WHEN (l_partkey + l_suppkey) % 11 = 0 THEN 'rate'
  WHEN (l_partkey + l_suppkey) % 13 = 0 THEN 'broken' ELSE 'plain' END"""


def oracle_sql() -> dict[str, str]:
    weighted_ref = _weighted(_PAIRS, "app_id, measure", "reference")
    weighted_std = _weighted(_PAIRS, "app_id, measure", "standard")
    small_pairs = "SELECT app_id, stage_id, executor_id, CAST(runtime_ms % 700 AS DOUBLE) AS value, runtime_ms AS weight FROM jt"
    weighted_small = _weighted(small_pairs, "app_id, stage_id, executor_id", "reference")
    sort_models = (*_ED, _models(0.6))
    disk_counters = ", ".join(
        (
            f"{_counter('sectors_read', 'launch_ms')} AS start_sectors_read",
            f"{_counter('sectors_written', 'finish_ms')} AS end_sectors_written",
            f"{_counter('millis_total', 'finish_ms')} AS end_millis_total",
        )
    )
    disk_rates = ", ".join(f"round({t.format(k='k')}, 6) AS {n}" for n, t in fixtures.DISK_RATES.items())
    estimate = """
wi AS (
  SELECT app_id, job_id, max(finish_ms) - min(start_ms) AS runtime_ms,
    sum(runtime_ms * (1 - CASE WHEN ser_deser_s > 0 THEN greatest(ideal_cpu_s - ser_deser_s, ideal_network_s, ideal_disk_s - disk_read_s) / ideal_s ELSE 1 END)) AS saved_ms
  FROM mo GROUP BY app_id, job_id
)"""
    phases = """
kb AS (SELECT mo.* FROM mo JOIN kept USING (app_id, job_id)),
kjb AS (
  SELECT app_id, job_id, sum(ideal_s) * 1000 AS ideal, sum(fixed_s) * 1000 AS fixed, sum(runtime_ms) AS actual,
    greatest(sum(ideal_cpu_s), sum(ideal_network_s), sum(ideal_disk_s)) * 1000 AS fluid
  FROM kb GROUP BY app_id, job_id
),
ph AS (
  SELECT app_id, CASE WHEN has_shuffle_read THEN 'reduce' ELSE 'map' END AS phase, runtime_ms AS actual, ideal_s * 1000 AS ideal,
    fixed_s * 1000 AS fixed, NULL AS fluid, CASE WHEN has_shuffle_read THEN ideal_cpu_s * 1000 END AS cpu FROM kb
  UNION ALL SELECT app_id, 'total', actual, ideal, fixed, fluid, NULL FROM kjb
)"""
    sql = {
        "s3_p1_p17_decoded_tasks": _with(
            _TASKS,
            body=f"SELECT {', '.join(_FLAT_TEXT.split())}, {_rounded(_FLAT_DOUBLE)}, "
            "round(CASE WHEN has_fetch THEN remote_mb + local_mb ELSE input_mb END, 6) AS input_size_mb FROM tk",
        ),
        "p6_task_disks": _with(
            _TASKS,
            f"dk AS (SELECT * FROM (VALUES {_DISK_VALUES}) AS v(disk, k))",
            body=f"SELECT app_id, task_id, launch_ms, disk, {disk_rates}, {disk_counters} FROM tk CROSS JOIN dk WHERE NOT (exec_no = 4 AND disk = 'xvdf')",
        ),
        "s4_bad_line_counts": _with(
            _TASKS,
            body="SELECT app_id, count(*) AS bad_lines FROM tk WHERE (l_partkey + l_suppkey) % 11 = 0 OR (l_partkey + l_suppkey) % 13 = 0 GROUP BY app_id",
        ),
        "s1_s5_one_pass": _with(
            _TASKS,
            body="SELECT app_id, CASE WHEN (l_partkey + l_suppkey) % 11 = 0 THEN 'broken' ELSE 'task' END AS kind, count(*) AS n, CAST(sum(CASE WHEN (l_partkey + l_suppkey) % 11 <> 0 THEN task_id END) AS BIGINT) AS sum_task_id FROM tk WHERE (l_partkey + l_suppkey) % 11 = 0 OR (l_partkey + l_suppkey) % 13 <> 0 GROUP BY ALL",
        ),
        "s4_s5_odd_lines": _with(
            _TASKS,
            f"kk AS (SELECT app_id, gc_ms, {_ODD_LINE} AS line FROM tk)",
            body="""
              SELECT app_id, 'tasks' AS reader, count(*) AS n, CAST(sum(CASE WHEN line IN ('plain', 'rate') THEN gc_ms END) AS BIGINT) AS sum_gc FROM kk WHERE line IN ('plain', 'rate', 'odd') GROUP BY app_id
              UNION ALL SELECT app_id, 'table_task', count(*), CAST(sum(CASE WHEN line IN ('plain', 'rate') THEN gc_ms END) AS BIGINT) FROM kk WHERE line IN ('plain', 'rate', 'odd') GROUP BY app_id
              UNION ALL SELECT app_id, 'odd_tasks', count(*), NULL FROM kk WHERE line = 'odd' GROUP BY app_id
              UNION ALL SELECT app_id, 'bad_lines', count(*), NULL FROM kk WHERE line = 'broken' GROUP BY app_id
              UNION ALL SELECT app_id, 'table_broken', count(*), NULL FROM kk WHERE line = 'broken' GROUP BY app_id""",
        ),
        "s1_s2_event_files": _with(
            _TASKS,
            body="SELECT app_id, count(*) AS n_tasks, count(*) AS n_places, first(task_id ORDER BY pos) AS first_task, last(task_id ORDER BY pos) AS last_task, CAST(sum(runtime_ms) AS BIGINT) AS runtime_ms FROM tk GROUP BY app_id",
        ),
        "f1_two_phase_tasks": _with(
            *_JT,
            body="SELECT app_id, job_id, count(*) AS n_tasks, CAST(sum(runtime_ms) AS BIGINT) AS runtime_ms FROM jt WHERE job_id % 4 = 1 GROUP BY app_id, job_id",
        ),
        "s9_odd_ticks": _with(
            _MONITOR,
            body="SELECT host, count(*) AS n_ticks, count(CASE WHEN event_id % 50 <> 3 THEN outstanding END) AS n_outstanding, CAST(sum(time_ms) AS BIGINT) AS sum_time_ms FROM tick GROUP BY host",
        ),
        "s8_monitor_files": _with(
            _MONITOR,
            body="SELECT host, count(*) AS n_ticks, first(time_ms ORDER BY time_ms, event_id) AS first_ms, last(time_ms ORDER BY time_ms, event_id) AS last_ms FROM tick GROUP BY host",
        ),
        "s5_mixed_log_events": _with(
            _TASKS,
            body="SELECT app_id, count(*) AS n_tasks, CAST(sum(task_id) AS BIGINT) AS sum_task_id FROM tk WHERE l_linenumber <> 7 GROUP BY app_id",
        ),
        "j3_job_names": _with(
            _JOB_STAGES,
            body=f"SELECT app_id, job_id, 'stage at ' || CAST(max(stage_id) AS VARCHAR) AS name, job_id * {fixtures.JOB_PERIOD_MS} AS submit_ms, count(*) AS n_stages, max(stage_id) AS top_stage FROM js GROUP BY app_id, job_id",
        ),
        "s7_experiment_params": "SELECT o_orderkey, o_custkey % 64 AS sort_num_tasks, o_orderkey % 9 AS sort_order, o_orderkey % 50 AS sort_num_shuffle_values, o_orderkey % 20 AS sweep_number, o_custkey % 1000 AS sweep_num_tasks, o_custkey % 8 AS threads FROM orders",
        "s6_missing_branches": _with(
            _TREE,
            body="SELECT q.query, b.branch FROM (SELECT DISTINCT query FROM tree) q CROSS JOIN (VALUES ('left'), ('right')) AS b(branch) ANTI JOIN tree t ON t.query = q.query AND t.branch = b.branch",
        ),
        "s6_unknown_branches": _with(
            _TREE,
            body="SELECT 'file:/logs/' || query || '/' || branch || '/event_log' AS path, query, branch FROM tree WHERE branch = 'extra'",
        ),
        "j1_job_tasks": _with(*_JT, body="SELECT app_id, job_id, stage_id, executor_id, task_id, launch_ms, runtime_ms FROM jt"),
        "j2_orphan_tasks": _with(
            _TASKS,
            _JOB_STAGES,
            body=f"SELECT app_id, stage_id, task_id, launch_ms, finish_ms FROM tk WHERE NOT EXISTS (SELECT 1 FROM js WHERE js.app_id = tk.app_id AND js.stage_id = tk.stage_id AND tk.finish_ms >= js.job_id * {fixtures.JOB_PERIOD_MS})",
        ),
        "f1_filtered_jobs": _with(*_JT, body="SELECT app_id, job_id, count(*) AS n_tasks FROM jt WHERE job_id % 2 = 1 GROUP BY app_id, job_id"),
        "f2_small_jobs": _with(*_ST, body="SELECT app_id, job_id, count(*) AS n_stages, max(n_tasks) AS max_tasks FROM stages GROUP BY app_id, job_id HAVING count(*) <= 1 AND max(n_tasks) > 5"),
        "f3_t5_jobs_from_second_shuffle": _with(*_ST, _SECOND_SHUFFLE, body="SELECT app_id, job_id, job_rank FROM kept"),
        "f4_jobs_after_setup": _with(_JOB_STAGES, body="SELECT * FROM ranked WHERE job_rank > 3 AND job_rank % 2 = 0"),
        "f5_jobs_after_warmup_trials": _with(_JOB_STAGES, body="SELECT * FROM ranked WHERE job_rank > 6 AND job_rank % 2 = 1"),
        "f6_jobs_without_warmup": _with(
            _JOB_STAGES,
            _EXPERIMENTS,
            body="SELECT app_id, job_id, query, branch, job_rank, job_rank - CASE WHEN query = '1a' THEN 2 ELSE 4 END AS trial_rank FROM ej JOIN ranked USING (app_id, job_id) WHERE job_rank > CASE WHEN query = '1a' THEN 2 ELSE 4 END",
        ),
        "f7_jobs_by_phase": _with(
            _JOB_STAGES,
            body="SELECT app_id, job_id, CASE WHEN job_id > 1 AND job_id <= ceil(n / 2.0) - 1 THEN 'write' ELSE 'read' END AS phase FROM (SELECT *, count(*) OVER (PARTITION BY app_id) AS n FROM jobs) WHERE (job_id > 1 AND job_id <= ceil(n / 2.0) - 1) OR job_id >= ceil(n / 2.0) + 1",
        ),
        "f8_shuffle_jobs": _with(*_ST, body="SELECT DISTINCT app_id, job_id FROM stages WHERE has_shuffle_read"),
        "a10_a11_a9_stage_summary": _with(
            *_ST,
            body=f"SELECT {_KS}, n_tasks, start_ms, finish_ms, runtime_ms, total_task_ms, max_task_ms, n_spilled, has_shuffle_read, {_rounded('mean_task_ms input_mb output_mb network_mb')} FROM stages",
        ),
        "a22_stage_input_labels": _with(
            *_JT,
            body=f"SELECT {_KS}, first(CASE WHEN has_fetch THEN 'shuffle' ELSE input_method END ORDER BY pos) AS input_label FROM jt GROUP BY {_KS}",
        ),
        "t3_longest_tasks": _with(
            *_JT,
            body=f"SELECT {_KS}, task_id, executor_id, launch_ms, finish_ms, runtime_ms FROM jt QUALIFY row_number() OVER (PARTITION BY {_KS} ORDER BY runtime_ms DESC, pos) = 1",
        ),
        "t2_last_significant_stage": _with(
            *_ST,
            body="SELECT app_id, job_id, coalesce(first(runtime_ms ORDER BY finish_ms DESC, stage_id) FILTER (WHERE runtime_ms > 60000), -1) AS last_stage_runtime_ms FROM stages GROUP BY app_id, job_id",
        ),
        "a16_a17_job_runtimes": _with(*_ST, body="SELECT * FROM runtimes"),
        "a1_task_runtime_summary": _with(*_JT, body=_summary("jt", "app_id", "runtime_ms")),
        "a1_job_runtime_summary": _with(*_ST, body=_summary("runtimes", "app_id", "runtime_ms")),
        "a4_a8_executor_stage_metrics": _with(
            *_EM,
            body=f"SELECT {_KE}, host, start_ms, end_ms, elapsed_ms, n_tasks, cpu_ms, tx_bytes, gc_ms, {_rounded('hdfs_deser_ms hdfs_ser_ms tx_idle_ms compute_ms disk_ms network_mb shuffle_read_mb tx_active_ms')}, {_ratios()} FROM em",
        ),
        "a7_j4_executor_stage_disks": _with(
            *_ED,
            body=f"SELECT {_KE}, elapsed_ms, disk, bytes_read, bytes_written, millis_reading, millis_writing, millis_total, round(millis_total / nullif(CAST(elapsed_ms AS DOUBLE), 0), 6) AS utilization, round(effective_Bps, 6) AS effective_Bps FROM ee",
        ),
        "a14_executor_job_metrics": _with(
            *_EM,
            f"""sj_ AS (SELECT app_id, job_id, executor_id, last(host ORDER BY end_ms, stage_id) AS host, min(start_ms) AS start_ms, max(end_ms) AS end_ms,
              CAST(sum(elapsed_ms) AS BIGINT) AS elapsed_ms, CAST(sum(n_tasks) AS BIGINT) AS n_tasks, CAST(sum(cpu_ms) AS BIGINT) AS cpu_ms,
              sum(hdfs_deser_ms) AS hdfs_deser_ms, sum(hdfs_ser_ms) AS hdfs_ser_ms, CAST(sum(tx_bytes) AS BIGINT) AS tx_bytes, sum(tx_idle_ms) AS tx_idle_ms,
              sum(tx_active_ms) AS tx_active_ms, CAST(sum(gc_ms) AS BIGINT) AS gc_ms FROM em GROUP BY app_id, job_id, executor_id)""",
            body=f"SELECT app_id, job_id, executor_id, host, start_ms, end_ms, elapsed_ms, n_tasks, cpu_ms, tx_bytes, gc_ms, {_rounded('hdfs_deser_ms hdfs_ser_ms tx_idle_ms tx_active_ms')}, {_ratios()} FROM sj_",
        ),
        "a14_executor_job_disks": _with(
            *_ED,
            body="SELECT app_id, job_id, executor_id, disk, CAST(sum(elapsed_ms) AS BIGINT) AS elapsed_ms, CAST(sum(bytes_read) AS BIGINT) AS bytes_read, CAST(sum(bytes_written) AS BIGINT) AS bytes_written, CAST(sum(millis_reading) AS BIGINT) AS millis_reading, CAST(sum(millis_writing) AS BIGINT) AS millis_writing, CAST(sum(millis_total) AS BIGINT) AS millis_total, round(sum(millis_total) / nullif(CAST(sum(elapsed_ms) AS DOUBLE), 0), 6) AS utilization, round(CASE WHEN sum(millis_total) = 0 THEN 0 ELSE sum(bytes_read + bytes_written) / CAST(sum(millis_total) AS DOUBLE) * 1000 END, 6) AS effective_Bps FROM ed GROUP BY app_id, job_id, executor_id, disk",
        ),
        "j5_executor_hosts": _with(*_JT, body="SELECT app_id, executor_id, last(host ORDER BY pos) AS host FROM jt GROUP BY app_id, executor_id"),
        "a2_a3_utilization_reference": _with(*_JT, weighted_ref[0], body=weighted_ref[1]),
        "a2_a3_utilization_standard": _with(*_JT, weighted_std[0], body=weighted_std[1]),
        "a2_stage_weighted_runtime": _with(*_JT, weighted_small[0], body=weighted_small[1]),
        "p22_idle_fractions": _with(
            *_JT,
            weighted_std[0],
            body=f"SELECT app_id, measure, round(1 - p25, 6) AS box_low, round(1 - p5, 6) AS whisker_low, round(1 - p95, 6) AS whisker_high, round(1 - p75, 6) AS box_high, round(1 - p50, 6) AS middle FROM ({weighted_std[1]}) WHERE measure IN ('cpu_utilization', 'disk_utilization', 'network_utilization')",
        ),
        "w3_compute_cdf": _with(*_JT, body=f'SELECT {_KS}, row_number() OVER (PARTITION BY {_KS} ORDER BY compute_ms) - 1 AS "index", CAST(compute_ms AS DOUBLE) AS compute_ms FROM jt'),
        "m1_m4_ideal_stage": _with(
            *_MO,
            body=f"SELECT {_KS}, n_executors, n_tasks, runtime_ms, n_disks, has_shuffle_read, CASE WHEN ideal_cpu_s = ideal_s THEN 'cpu' WHEN ideal_network_s = ideal_s THEN 'network' ELSE 'disk' END AS bottleneck, {_rounded('network_mb ideal_cpu_s ideal_network_s ideal_disk_s ideal_s')} FROM mo",
        ),
        "m3b_m5b_ideal_from_disk_times": _with(
            *_MO,
            body=f"SELECT {_KS}, round(ideal_disk_task_s, 6) AS ideal_disk_s, round(fixed_disk_task_s, 6) AS fixed_disk_s, round(greatest(ideal_cpu_s, ideal_network_s, ideal_disk_task_s), 6) AS ideal_s, round(greatest(fixed_cpu_s, fixed_network_s, fixed_disk_task_s), 6) AS fixed_s FROM mo",
        ),
        "m5_ideal_stage_fixed": _with(*_MO, body=f"SELECT {_KS}, {_rounded('fixed_cpu_s fixed_network_s fixed_disk_s fixed_s')} FROM mo"),
        "m6_m7_ser_and_disk_read": _with(*_MO, body=f"SELECT {_KS}, {_rounded('ser_deser_s disk_read_s')} FROM mo"),
        "m8_m9_ideal_job": _with(
            *_MO,
            body=f"SELECT app_id, job_id, n_stages, round(actual_s / ideal_s, 6) AS actual_over_ideal, CASE WHEN cpu_s = fluid_s THEN 'cpu' WHEN network_s = fluid_s THEN 'network' ELSE 'disk' END AS bottleneck, {_rounded('ideal_s fixed_s cpu_s network_s disk_s ser_deser_s actual_s total_stage_s fluid_s')} FROM mj",
        ),
        "m10_what_if_in_memory": _with(*_MO, estimate, body="SELECT app_id, job_id, runtime_ms, round(saved_ms, 6) AS saved_ms, round(runtime_ms - saved_ms, 6) AS estimate_ms FROM wi"),
        "m11_counter_checks": _with(
            *_MO,
            f"""ck AS (
              SELECT {_KS}, 'cpu_ms' AS "check", CAST(compute_ms AS DOUBLE) AS base, CAST(os_cpu_ms AS DOUBLE) AS other FROM mo
              UNION ALL SELECT {_KS}, 'network_mb', network_mb, floor(tx_bytes / CAST(1048576 AS DOUBLE)) FROM mo)""",
            body=f'SELECT {_KS}, "check", round(base, 6) AS base, round(other, 6) AS other, round(abs(other - base) / base, 6) AS rel_diff, abs(other - base) / base > 0.1 AND other > 0 AS flagged FROM ck WHERE base > 0',
        ),
        "g2_small_job_tasks": _with(
            *_ST,
            "sm_ AS (SELECT app_id, job_id FROM stages GROUP BY app_id, job_id HAVING count(*) <= 1 AND max(n_tasks) > 5)",
            "sjt AS (SELECT jt.* FROM jt JOIN sm_ USING (app_id, job_id))",
            body=_summary("sjt", "app_id, job_id", "runtime_ms"),
        ),
        "g3_sort_phases": _with(
            *sort_models[:3],
            _STAGES,
            *sort_models[3:],
            _SECOND_SHUFFLE,
            phases,
            body="SELECT app_id, phase, " + ", ".join(_min_med_max(v, v + "_{}_s", " / 1000") for v in ("actual", "ideal", "fixed", "fluid", "cpu")) + " FROM ph GROUP BY app_id, phase",
        ),
        "g4_k8_task_sweep": _with(
            *_MO,
            _SWEEP_ROWS,
            body="SELECT app_id, num_tasks, " + ", ".join(_min_med_max(v, v + "_{}") for v in _SWEEP_VALUES) + " FROM rows_ JOIN nt USING (app_id) GROUP BY app_id, num_tasks",
        ),
        "p23_sweep_plot_columns": _with(
            *_MO,
            _SWEEP_ROWS,
            body="SELECT app_id, num_tasks, "
            + ", ".join(_min_med_max(v, v + "_{}_s", " / 1000") for v in _SWEEP_VALUES if v != "ratio")
            + ", " + _min_med_max("ratio", "rel_diff_{}", " - 1")
            + " FROM rows_ JOIN nt USING (app_id) GROUP BY app_id, num_tasks",
        ),
        "w4_paired_trials": _with(*_ST, _EXPERIMENTS, _trials("runtimes"), body="SELECT app_id, query, branch, trial, CAST(runtime_ms AS BIGINT) AS runtime_ms, complete FROM tr"),
        "g5_k9_t4_benchmark_lines": _with(
            *_ST, _EXPERIMENTS, _trials("runtimes"),
            body=f"SELECT query, branch, n, x, incomplete_trials, {_rounded('median_s min_s max_s')} FROM ({_lines('tr', 'query, branch')})",
        ),
        "j7_benchmark_compare": _with(
            *_ST, _EXPERIMENTS, _trials("runtimes"), f"li AS ({_lines('tr', 'query, branch')})",
            body="SELECT query, x, "
            + ", ".join(
                f"round(max(CASE WHEN branch = '{b}' THEN {c} END), 6) AS {b}_{c}"
                for b in ("left", "right") for c in ("median_s", "min_s", "max_s")
            )
            + ", round(max(CASE WHEN branch = 'left' THEN median_s END) / max(CASE WHEN branch = 'right' THEN median_s END), 6) AS ratio FROM li GROUP BY query, x",
        ),
        "g6_estimate_report": _with(
            *_MO, estimate, _EXPERIMENTS,
            "me AS (SELECT app_id, job_id, CAST(runtime_ms AS DOUBLE) AS runtime_ms FROM wi)",
            "es AS (SELECT app_id, job_id, runtime_ms - saved_ms AS runtime_ms FROM wi)",
            _trials("me", name="ta"), _trials("es", name="tb"),
            "tr AS (SELECT *, 'measured' AS kind FROM ta UNION ALL SELECT *, 'estimate' FROM tb)",
            body=f"SELECT query, branch, kind, n, x, incomplete_trials, {_rounded('median_s min_s max_s')} FROM ({_lines('tr', 'query, branch, kind')})",
        ),
        "g8_a20_threads_box": _with(
            *_ST,
            f"""ph AS (SELECT app_id, job_id, 1 + CAST(substr(app_id, 5) AS BIGINT) % 4 AS threads, CASE WHEN job_id > 1 AND job_id <= ceil(n / 2.0) - 1 THEN 'write' WHEN job_id >= ceil(n / 2.0) + 1 THEN 'read' END AS phase
              FROM (SELECT *, count(*) OVER (PARTITION BY app_id) AS n FROM jobs)),
            sc AS (SELECT phase, threads, runtime_ms / CAST(1000 AS DOUBLE) AS runtime_s FROM ph JOIN runtimes USING (app_id, job_id) WHERE phase IS NOT NULL)""",
            body=_summary("sc", "phase, threads", "runtime_s", (25, 50, 75)),
        ),
        "g9_p20_monitor_samples": _with(
            _MONITOR,
            body=f"SELECT host, event_id, time, running_compute, running_tasks, local_running_tasks, tasks_in_network, tasks_in_compute, tasks_in_disk, low_priority_network, outstanding_network_mb, total_started, has_total_started, {_rounded('cpu_utilization cpu_system bytes_received bytes_transmitted gc_fraction free_heap_gib free_off_heap_gib')} FROM ms",
        ),
        "j6_monitor_disks": _with(_MONITOR, body=f"SELECT host, event_id, time, disk, running, queued_reads, queued_removes, queued_writes, {_rounded('utilization read_Bps write_Bps')} FROM md_"),
        "s8_s9_decoded_monitor": _with(
            _MONITOR,
            "okd AS (SELECT *, NOT (time_ms < 1704153600000 OR event_id % 1000 = 999) AS ok FROM tick)",
            "fg AS (SELECT *, min(CASE WHEN ok THEN time_ms * 1000000 + event_id END) OVER (PARTITION BY host) AS first_good FROM okd)",
            "sp AS (SELECT *, min(CASE WHEN NOT ok AND time_ms * 1000000 + event_id > first_good THEN time_ms * 1000000 + event_id END) OVER (PARTITION BY host) AS stop FROM fg)",
            body="SELECT host, event_id, time_ms, total_started, isnan(rx) AS rx_nan FROM sp WHERE ok AND (stop IS NULL OR time_ms * 1000000 + event_id < stop)",
        ),
        "p21_monitor_panels": _with(
            _MONITOR,
            body="SELECT host, panel, metric, disk, count(*) AS n, round(avg(value), 6) AS mean, round(max(value), 6) AS highest FROM (" + " UNION ALL ".join(_PANEL_ROWS) + ") GROUP BY host, panel, metric, disk",
        ),
        "p24_disk_series": _with(_MONITOR, body="SELECT host, event_id, time, CAST(running AS DOUBLE) AS value FROM md_ WHERE disk = 'xvdb'"),
        "w5_started_deltas": _with(_MONITOR, _DELTAS, body="SELECT host, event_id, time, delta FROM dl WHERE delta > 0"),
        "k10_started_spikes": _with(
            _MONITOR, _DELTAS,
            body="SELECT host, event_id, time, CAST(point AS INTEGER) AS point, CASE WHEN point = 1 THEN delta ELSE 0 END AS height FROM dl CROSS JOIN (VALUES (0), (1), (2)) AS p(point) WHERE delta > 0",
        ),
        "s10_f14_work_lines": _with(_EV, _WORK, body="SELECT * FROM pl"),
        "w7_w8_waterfall": _with(_EV, _WORK, body="SELECT * FROM wl"),
        "g10_waterfall_extent": _with(
            _EV, _WORK,
            'sz AS (SELECT file, island, max(start + runtime_ms) AS "end", count(*) AS lanes, max(island) OVER (PARTITION BY file) AS last_island FROM wl GROUP BY file, island)',
            body='SELECT file, greatest(0, max("end")) AS last_end, max(lanes) AS max_lanes, coalesce(max(CASE WHEN island < last_island THEN lanes END), 0) AS max_lanes_ref FROM sz GROUP BY file',
        ),
    }
    sql["a15_load_balance"], sql["a15_a1_load_balance_summary"] = _balance()
    sql["g7_a19_a21_num_tasks"], sql["g7_compare_systems"] = _num_tasks()
    sql["x3_x4_scaled_units"] = _units()
    for name in _FINE:
        sql[name] = sql[name].replace(", 6)", ", 9)")
    of_app = "SELECT *, CAST(substr(app_id, 5) AS BIGINT) AS app_no FROM"
    sql["k7_g3_sort_runs"] = (
        "SELECT 100 * (1 + app_no % 3) AS num_tasks, 9 - app_no AS run_order, 10 * (1 + app_no % 2) AS num_shuffle_values, "
        f"g.* EXCLUDE (app_id, app_no) FROM ({of_app} ({sql['g3_sort_phases']})) g"
    )
    sql["g4_sweep_runs"] = (
        f"SELECT 7 * (app_no + 1) AS number, g.* EXCLUDE (app_id, app_no) FROM ({of_app} ({sql['g4_k8_task_sweep']})) g"
    )
    sql["g5_log_reports"], sql["g1_default_report"] = _figures(weighted_ref)
    return sql


_RESOURCES = "elapsed_ms n_tasks cpu_ms hdfs_deser_ms hdfs_ser_ms tx_bytes tx_idle_ms gc_ms"
_JOB_RESOURCES = f"sj AS (SELECT app_id, job_id, executor_id, {', '.join(f'sum({c}) AS {c}' for c in _RESOURCES.split())} FROM em GROUP BY app_id, job_id, executor_id)"
_JOB_DISKS = """jd AS (
  SELECT app_id, job_id, executor_id, disk, sum(elapsed_ms) AS elapsed_ms, sum(bytes_read) AS bytes_read, sum(bytes_written) AS bytes_written, sum(millis_total) AS millis_total
  FROM ee GROUP BY app_id, job_id, executor_id, disk
)"""


def _long(source: str, report: str, keys: str, figures: str) -> str:
    """One row per figure with a value; `keys` names the ones that the report has."""
    own = dict.fromkeys("job_id stage_id executor_id measure".split(), "NULL")
    own |= dict(k.split("=") if "=" in k else (k, k) for k in keys.split())
    kinds = {"job_id": "BIGINT", "stage_id": "BIGINT", "executor_id": "VARCHAR", "measure": "VARCHAR"}
    columns = ", ".join(f'CAST({of} AS {kinds[k]}) AS {k}' for k, of in own.items())
    rows = " UNION ALL ".join(
        f"SELECT app_id, '{report}' AS report, {columns}, '{f}' AS figure, round(CAST({f} AS DOUBLE), 6) AS value FROM {source}"
        for f in figures.split()
    )
    return f"SELECT * FROM ({rows}) WHERE value IS NOT NULL"


def _figures(weighted: tuple[str, str]) -> tuple[str, str]:
    measured = (
        _EXPERIMENTS,
        "fj AS (SELECT app_id, job_id FROM ej JOIN ranked USING (app_id, job_id) WHERE job_rank > CASE WHEN query = '1a' THEN 1 ELSE 2 END)",
        _JOB_TASKS.replace("jt AS (", "jt_every AS (", 1),
        "jt AS (SELECT e.* FROM jt_every e SEMI JOIN fj ON fj.app_id = e.app_id AND fj.job_id = e.job_id)",
    )
    shared = (_METRICS, _DISKS, _models(), _JOB_RESOURCES, weighted[0])
    share = "n p5 p25 p50 p75 p95 p99 mean"
    ideal = "ideal_cpu_s ideal_network_s ideal_disk_s ser_deser_s ideal_s"
    stage, executor = "job_id stage_id", "executor_id"
    logs = [
        _long("em", "stage_resources", f"{stage} {executor}", _RESOURCES),
        _long("sj", "job_resources", f"job_id {executor}", _RESOURCES),
        _long("wp", "utilizations", "measure", share),
        _long("mo", "ideal_stage", stage, ideal),
        _long("mj", "ideal_job", "job_id", "ideal_s actual_s total_stage_s"),
    ]
    shares = f"wp AS ({weighted[1]})"
    whole = "n p5 p25 p50 p75 p95 min max"
    spans = (
        f"sp AS (SELECT {_KE}, min(launch_ms) AS first_ms, max(finish_ms) AS last_ms FROM jt GROUP BY {_KE})",
        f"lb AS (SELECT {_KS}, max(last_ms) - min(first_ms) AS runtime_ms, CAST(sum(last_ms - first_ms) AS BIGINT) // count(*) AS ideal_ms FROM sp GROUP BY {_KS})",
        "lc AS (SELECT *, runtime_ms / nullif(CAST(ideal_ms AS DOUBLE), 0) AS badness FROM lb)",
        f"s1 AS ({_summary('jt', 'app_id', 'runtime_ms')})",
        f"s2 AS ({_summary('runtimes', 'app_id', 'runtime_ms')})",
        f"s3 AS ({_summary('lc', 'app_id', 'badness')})",
    )
    checks = f"""ck AS (
  SELECT * , abs(other - base) / base AS rel_diff FROM (
    SELECT {_KS}, 'cpu_ms' AS "check", CAST(compute_ms AS DOUBLE) AS base, CAST(os_cpu_ms AS DOUBLE) AS other FROM mo
    UNION ALL SELECT {_KS}, 'network_mb', CAST(network_mb AS DOUBLE), floor(tx_bytes / CAST(1048576 AS DOUBLE)) FROM mo
  ) WHERE base > 0
)"""
    disk = "bytes_read bytes_written millis_total utilization effective_Bps"
    rated = "*, millis_total / nullif(CAST(elapsed_ms AS DOUBLE), 0) AS utilization"
    speed = "CASE WHEN millis_total = 0 THEN 0 ELSE (bytes_read + bytes_written) / CAST(millis_total AS DOUBLE) * 1000 END AS effective_Bps"
    default = [
        _long("s1", "task_runtimes", "", whole),
        _long("s2", "runtimes", "", whole),
        _long("s3", "load_balance", "", whole),
        logs[0].replace("'stage_resources'", "'stage_resource_metrics'"),
        logs[1].replace("'job_resources'", "'job_resource_metrics'"),
        *logs[2:],
        _long("e1", "stage_disks", f"{stage} {executor} measure=disk", disk),
        _long("e2", "job_disks", f"job_id {executor} measure=disk", disk),
        _long("ck", "counter_checks", f'{stage} measure="check"', "base other rel_diff"),
    ]
    disks = (_JOB_DISKS, f"e1 AS (SELECT {rated} FROM ee)", f"e2 AS (SELECT {rated}, {speed} FROM jd)")
    return (
        _with(_TASKS, _JOB_STAGES, *measured, *shared, shares, body=" UNION ALL ".join(logs)),
        _with(*_ST, *shared, shares, *spans, *disks, checks, body=" UNION ALL ".join(default)),
    )


def _balance() -> tuple[str, str]:
    spans = (
        f"sp AS (SELECT {_KE}, min(launch_ms) AS first_ms, max(finish_ms) AS last_ms FROM jt GROUP BY {_KE})",
        f"lb AS (SELECT {_KS}, max(last_ms) - min(first_ms) AS runtime_ms, CAST(sum(last_ms - first_ms) AS BIGINT) AS span_ms, count(*) AS n_executors, CAST(sum(last_ms - first_ms) AS BIGINT) // count(*) AS ideal_ms FROM sp GROUP BY {_KS})",
        "lc AS (SELECT *, runtime_ms / nullif(CAST(ideal_ms AS DOUBLE), 0) AS badness FROM lb)",
    )
    rows = _with(*_JT, *spans, body=f"SELECT {_KS}, runtime_ms, span_ms, n_executors, ideal_ms, round(badness, 6) AS badness FROM lc")
    return rows, _with(*_JT, *spans, body=_summary("lc", "app_id", "badness"))


def _num_tasks() -> tuple[str, str]:
    rows = f"""
sy AS (
  SELECT app_id, job_id, {fixtures.BRANCH_OF_APP} AS system, 100 * (1 + app_no % 3) AS num_tasks
  FROM (SELECT *, CAST(substr(app_id, 5) AS BIGINT) AS app_no FROM ranked) WHERE job_rank > 4 AND job_rank % 2 = 1
),
sc AS (SELECT system, num_tasks, runtime_ms / CAST(1000 AS DOUBLE) AS runtime_s FROM sy JOIN runtimes USING (app_id, job_id)),
nr AS (
  SELECT system, num_tasks, count(*) AS n, quantile_cont(runtime_s, 0.5) AS p50, min(runtime_s) AS min, max(runtime_s) AS max
  FROM sc GROUP BY system, num_tasks
)"""
    report = _with(*_ST, rows, body=f"SELECT system, num_tasks, n, {_rounded('p50 min max')}, round(p50 - min, 6) AS err_low, round(max - p50, 6) AS err_high FROM nr")
    compare = _with(*_ST, rows, body="SELECT num_tasks, round(max(CASE WHEN system = 'left' THEN p50 END), 6) AS left_median_s, round(max(CASE WHEN system = 'right' THEN p50 END), 6) AS right_median_s, round(max(max), 6) AS max_s FROM nr GROUP BY num_tasks")
    return report, compare


def _units() -> str:
    size = "floor(pow(CAST(10 AS DOUBLE), o_orderkey % 11) * o_totalprice) * CASE WHEN o_custkey % 2 = 0 THEN -1 ELSE 1 END"
    cases = [(f"CAST({1 << (10 * p)} AS DOUBLE)", p) for p in (4, 3, 2, 1)]

    def choose(results) -> str:
        whens = " ".join(f"WHEN abs(size) >= 2 * {factor} THEN {results(factor, p)}" for factor, p in cases)
        return f"CASE {whens} ELSE {results('CAST(1 AS DOUBLE)', 0)} END"

    return (
        f"WITH s AS (SELECT o_orderkey, {size} AS size FROM orders) SELECT o_orderkey, "
        f"round({choose(lambda f, p: f'size / {f}')}, 6) AS bytes_value, "
        + choose(lambda f, p: "'" + ["B", "KB", "MB", "GB", "TB"][p] + "'") + " AS bytes_unit, "
        + f"round({choose(lambda f, p: f'size / {f}')}, 6) AS bits_value, "
        + choose(lambda f, p: "'" + ["b", "Kb", "Mb", "Gb", "Tb"][p] + "'") + " AS bits_unit FROM s"
    )
