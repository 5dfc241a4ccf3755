import sys
import uuid
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from loreloom.session import local_session

    session = local_session(cpus=4, shuffle_partitions=4, memory="4g")
    session.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("checkpoints")))
    yield session
    session.stop()


@pytest.fixture(scope="session")
def moved_bytes():
    """Bytes that a query writes to shuffles."""

    def measure(spark, df):
        context, name = spark.sparkContext, uuid.uuid4().hex
        context.setJobGroup(name, "measured")
        df.write.format("noop").mode("overwrite").save()
        context._jsc.sc().listenerBus().waitUntilEmpty(30_000)
        context._jsc.clearJobGroup()
        tracker, store, total = context.statusTracker(), context._jsc.sc().statusStore(), 0
        for stage in {s for job in tracker.getJobIdsForGroup(name) for s in tracker.getJobInfo(job).stageIds}:
            total += store.lastStageAttempt(stage).shuffleWriteBytes()
        return total

    return measure
