import gc
import re
import time
from pathlib import Path

from loomgraph.llm.common import materialize

PIECES, BYTES = 3000, 64 * 1024


def anonymous_mb(pid: int) -> float:
    return sum(map(int, re.findall(r"\nAnonymous:\s+(\d+)", Path(f"/proc/{pid}/smaps_rollup").read_text()))) / 1024


def test_materialize_returns_what_the_driver_freed_outside_its_heap(spark):
    jvm = spark.sparkContext._jvm
    pid = int(jvm.java.lang.ProcessHandle.current().pid())
    materialize(spark.range(10), "warm")
    pieces, kept = jvm.java.util.ArrayList(), jvm.java.util.ArrayList()
    for k in range(PIECES):
        (pieces if k % 50 else kept).add(jvm.java.nio.ByteBuffer.allocateDirect(BYTES))  # those kept hold the others' place in malloc's arena
    full = anonymous_mb(pid)
    del pieces
    pools = jvm.java.lang.management.ManagementFactory.getPlatformMXBeans(jvm.java.lang.Class.forName("java.lang.management.BufferPoolMXBean"))
    until = time.time() + 60
    while sum(p.getMemoryUsed() for p in pools) > PIECES * BYTES / 10 and time.time() < until:  # Python lets go of them by and by
        gc.collect()
        jvm.java.lang.System.gc()
        time.sleep(0.5)
    assert sum(p.getMemoryUsed() for p in pools) <= PIECES * BYTES / 10
    out = materialize(spark.range(10), "after")
    assert full - anonymous_mb(pid) > 0.5 * PIECES * BYTES / 2**20
    assert out.count() == 10 and kept.size() == PIECES // 50
