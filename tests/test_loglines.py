import random

from tidemark.operators import loglines

LINES = [
    ("    at x.y(Z.java:1)", None),
    ("\ufeff07-07 11:34:53.380  5225  7822 W kernel: mmc busy", ("WARN", "kernel", "mmc busy")),
    ("    at x.y(Z.java:1)", None),
    ("", None),
    ("| 2025-02-10 01:10:22 peer said matrix", None),
    ("[CRITICAL] [2025/01/06 23:16:32] kernel - page cache\r", ("FATAL", "kernel", "page cache")),
    ("WARN  06 Jan 2024 18:06:30,995 (worker-0) com.fleet.ota - policy cache", ("WARN", "com.fleet.ota", "policy cache")),
    ("E0729 11:53:47.646339  2536 flash_agent.cc:476] sector map", ("ERROR", "", "sector map")),
    ("<94>1 2024-12-29T02:18:00Z tbox storage_svc 1406 - - 写入队列", ("INFO", "storage_svc", "写入队列")),
    ("ts=2026-07-31T22:05:09.854613+05:30 level=trace comp=storage_svc 分区 gen=4", ("TRACE", "storage_svc", "分区 gen=4")),
    ("2026-01-18 12:30:42.477 4454 6018 I kernel: ERROR counter reset", ("INFO", "kernel", "ERROR counter reset")),
    ("2026-06-04 14:37:38.141 [ota_master] DEBUG vehicle gate", ("DEBUG", "ota_master", "vehicle gate")),
    ("2025-01-20 22:11:40 [信息] ERROR counter reset, 分区", ("INFO", "", "ERROR counter reset, 分区")),
    ("2024-01-11 13:34:47 【调试】分区扫描", ("DEBUG", "", "分区扫描")),
    ("2024-01-18T02:18:33.034+08:00|Warning|campaign_client|manifest poll", ("WARN", "campaign_client", "manifest poll")),
    ("20240205 080614.164;PANIC;power_mgr;cell balancer", ("FATAL", "power_mgr", "cell balancer")),
    ("2025/01/20 22:27:17.264396 ECU1 UDS_ MAIN log debug seed", ("DEBUG", "UDS_", "seed")),
    ("Dec  7 16:51:47 tbox power_mgr[2472]: ERROR counter reset", ("UNKNOWN", "power_mgr", "ERROR counter reset")),
    ("[ 2560.059457] thermal zone", ("UNKNOWN", "", "thermal zone")),
    ("[ 2560.059457] <3>thermal zone", ("ERROR", "", "thermal zone")),
    ("+1668.600s NOTICE boot counter", ("NOTICE", "", "boot counter")),
    ("02-06 22:32:17 INFO replayed: 02-05 10:00:00 WARN x", ("INFO", "", "replayed: 02-05 10:00:00 WARN x")),
    ('{"pid": 1, "msg": "key slot", "lvl": "3", "module": "verify_svc", "ts": "2024-08-29T12:30:10Z"}', ("ERROR", "verify_svc", "key slot")),
    ('{"state": "x"}', None),
    ("x" * 200_000, None),
    (None, None),
]
SCHEMA = "file_id int, line_no bigint, raw_line string, template string, block int, shape string"


def rows(file, lines, start=1):
    return [(file, start + i, text, "t", 1, "s") for i, (text, _) in enumerate(lines)]


def model(lines, start=1):
    out = []
    for i, (_, want) in enumerate(lines):
        if want:
            out.append([start + i, 1, want[0], want[1], want[2]])
        elif out:
            out[-1][1] += 1
    return sorted(map(tuple, out))


#: lines to learn the layouts from: level, component, message in the places that the lines above have them in
LEARNED = [
    "07-07 11:34:53.380  5225  {n} {l} {c}: {m}", "[{L}] [2025/01/06 23:16:32] {c} - {m}", "{L}  06 Jan 2024 18:06:30,995 (worker-{n}) com.fleet.{c} - {m}",
    "{l}0729 11:53:47.646339  2536 {c}.cc:{n}] {m}", "<9{p}>1 2024-12-29T02:18:00Z tbox {c} 14{n} - - {m}", "ts=2026-07-31T22:05:09.854613+05:30 level={L} comp={c} {m}",
    "2026-06-04 14:37:38.141 [{c}] {L} {m}", "2025-01-20 22:11:40 [{L}] {m}", "2024-01-11 13:34:47 【{L}】{m}", "2024-01-18T02:18:33.034+08:00|{L}|{c}|{m}",
    "20240205 080614.164;{L};{c};{m}", "2025/01/20 22:27:17.264396 ECU1 UDS_ MAIN log {L} {m}", "Dec  7 16:51:47 tbox {c}[{n}]: {m}", "[ 2560.05{n}] {m}",
    "[ 2560.05{n}] <{p}>{m}", "+1668.6{n}s {L} {m}", "02-06 22:32:17 {L} {m}",
]
NAMES = ["kernel", "power_mgr", "ota_master", "verify_svc", "tbox_comm"]
WORDS = "mmc page sector map policy counter gate seed zone slot queue frame cache thermal".split()


def learned(layouts, lines=60):
    """Lines of a file 9 in each layout; some messages begin with a level word or a word and a colon."""
    rnd = random.Random(4)
    out = []
    for layout in layouts:
        for i in range(lines):
            m = " ".join(rnd.choice(WORDS) for _ in range(rnd.randint(2, 5))) + f" ref={i:x}"
            m = rnd.choice([m] * 30 + [f"ERROR {m}", f"replayed: {m}"])
            level = rnd.choice(["INFO", "warn", "Error", "debug"])
            out.append((layout.format(n=rnd.randint(10, 99), p=rnd.randint(0, 7), l=level[0].upper(), L=level, c=rnd.choice(NAMES), m=m), None))
    return rows(9, out)


def solve(spark, data, block=5000, layouts=LEARNED):
    found = loglines.entries(spark.createDataFrame(data + learned(layouts), SCHEMA), "file_id", "line_no", "raw_line", block).collect()
    return {f: sorted((r.line_no, r.line_span, r.level_norm, r.logger, r.message) for r in found if r.file_id == f) for f in {r.file_id for r in found} - {9}}


def test_layouts_spans_and_repeats_for_any_block(spark):
    data = rows(1, LINES) + rows(2, LINES[4:], 50) + rows(1, LINES)[3:9] + [(None, 1, "02-06 22:32:17 INFO a", "t", 1, "s"), (1, None, "b", "t", 1, "s")]
    want = {1: model(LINES), 2: model(LINES[4:], 50)}
    assert solve(spark, data) == want
    assert solve(spark, data, 4) == want


def test_empty_table_and_file_without_head(spark):
    assert loglines.entries(spark.createDataFrame([], SCHEMA), "file_id", "line_no", "raw_line").count() == 0
    assert solve(spark, rows(1, [("a", None), (None, None)])) == {}


def test_layouts_that_the_code_does_not_name_are_learned(spark):
    unseen = ["2025-01-02 03:04:05 {c} :: {L} :: {m}", "{L} 2025-01-02 03:04:05.123 (src/net/gw/can/frame/queue.c:{n}) {c} - {m}"]
    lines = [
        ("2025-01-02 03:04:05 core :: INFO :: text", ("INFO", "core", "text")),
        ("\tat x", None),
        ("DEBUG 2025-01-02 03:04:05.123 (src/net/gw/can/frame/queue.c:12) core - x: y", ("DEBUG", "core", "x: y")),
        ("since: 2025-01-02 03:04:05 nothing", None),
        ("2025-01-02 03:04:06 gate :: ERROR :: INFO is late", ("ERROR", "gate", "INFO is late")),
    ]
    assert solve(spark, rows(1, lines), layouts=unseen) == {1: model(lines)}


def test_a_merge_can_fail(spark):
    """At one position of one stem, levels in brackets and components in brackets are two templates; a rare level word in messages is none."""
    leaf = lambda lead, n, *words: loglines.Leaf(len(lead), lead, n, (0, *words, *[-1 & (2**64 - 1)] * 12))
    leaves = [leaf("T[L]WW", 30, 0, 7, 0), leaf("T[W]LWW", 90, 0, 0xF0, 0, 7), leaf("TLWW", 300, 7), leaf("TLLWW", 9, 7, 1)]
    at = {x.lead: f for part, f in loglines._learn(leaves, 0, loglines.Fields()) for x in part}
    assert (at["T[L]WW"].level, at["T[L]WW"].names) == (2, ())
    assert (at["T[W]LWW"].level, at["T[W]LWW"].names) == (4, ((2, 4),))
    assert at["TLLWW"].level == at["TLWW"].level == 1 and at["TLLWW"].end == 2


def test_long_lines_of_marks_and_repeats(spark):
    data = [(1, 1, "2025-01-20 22:11:40 INFO x" + "-" * 100_000, "", 1, ""), (1, 2, "a" + "-" * 100_000, "", 1, ""), (1, 3, "a.-" * 60_000, "", 1, "")]
    assert solve(spark, data * 2, layouts=LEARNED[-1:])[1] == [(1, 3, "INFO", "", "x" + "-" * 100_000)]
