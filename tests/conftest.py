import datetime as dt

import pytest
from pyspark.sql import types as T

from voxloom.schema import FEEDBACK
from voxloom.session import build_session

NULLABLE_FEEDBACK = T.StructType([T.StructField(f.name, f.dataType, True) for f in FEEDBACK])


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = build_session(
        "voxloom-tests",
        "local[8]",
        **{
            "spark.sql.shuffle.partitions": "8",
            "spark.ui.enabled": "false",
            "spark.driver.memory": "6g",
            "spark.sql.maxMetadataStringLength": "10000",
            "spark.checkpoint.dir": str(tmp_path_factory.mktemp("checkpoints")),
        },
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


def moment(day, hour=0, minute=0):
    return dt.datetime(2024, 1, day, hour, minute)


def feedback_row(id, **given):
    row = {
        "id": id,
        "created_at": moment(1, 0, id % 60),
        "channel": "github",
        "title": f"title {id}",
        "content": f"text {id}",
        "author": "ann",
        "sentiment": "neutral",
        "sentiment_score": 0.0,
        "theme": "pricing",
        "urgency": "low",
        "value_score": "medium",
        "analyzed": 1,
    }
    return {**row, **given}


@pytest.fixture(scope="session")
def make_feedback(spark):
    def make(rows):
        tuples = [tuple(row[name] for name in FEEDBACK.names) for row in rows]
        return spark.createDataFrame(tuples, NULLABLE_FEEDBACK)

    return make


SMALL = [
    feedback_row(1, theme="pricing", sentiment="positive", sentiment_score=0.9, urgency="critical"),
    feedback_row(2, theme="pricing", sentiment="negative", sentiment_score=-0.5, urgency="high"),
    feedback_row(
        3, theme="reliability", sentiment="negative", sentiment_score=-1.0, urgency="critical",
        created_at=moment(2),
    ),
    feedback_row(4, theme="reliability", sentiment="mixed", sentiment_score=None, urgency="medium",
                 created_at=moment(2)),
    feedback_row(5, theme="uncategorized", sentiment="neutral", channel="forum"),
    feedback_row(6, theme=None, sentiment="positive", sentiment_score=0.4, channel="forum"),
    feedback_row(7, theme="pricing", sentiment="pending", analyzed=0, channel="email", urgency="high"),
    feedback_row(8, theme="API-docs", sentiment="positive", sentiment_score=0.2, urgency="severe",
                 value_score="low", created_at=moment(5), title=""),
]


@pytest.fixture(scope="session")
def small(make_feedback):
    return make_feedback(SMALL).cache()


@pytest.fixture(scope="session")
def empty(make_feedback):
    return make_feedback([])


def rows_of(frame):
    return [row.asDict(recursive=True) for row in frame.collect()]
