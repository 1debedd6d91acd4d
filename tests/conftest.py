import pytest

from palaver.plans import ingest
from palaver.session import SINGLE_NODE, build_session
from palaver.sources.raw import conform
from palaver.sources.schemas import RAW


@pytest.fixture(scope="session")
def spark():
    session = build_session("tests", "local[4]", 4, SINGLE_NODE)
    session.sparkContext.setLogLevel("ERROR")
    yield session


def _ns(day, hour, minute):
    from datetime import datetime, timezone

    return int((datetime(2024, 6, day, hour, minute, tzinfo=timezone.utc).timestamp() - 978307200) * 10**9)


@pytest.fixture(scope="session")
def raw(spark):
    """Ten rows: a direct chat with each of two friends and one group."""
    rows = [  # id, chat, handle (0 = owner), time, text, reaction code, target
        (1, 1, 1, (1, 12, 0), "hey 😂", 0, None), (2, 1, 0, (1, 12, 2), "yo!", 0, None),
        (3, 1, 0, (2, 9, 0), "morning", 0, None), (4, 1, 1, (2, 9, 5), "hi", 0, None),
        (5, 3, 2, (1, 18, 0), "sup", 0, None), (6, 2, 1, (1, 13, 0), "group hi", 0, None),
        (7, 2, 2, (1, 13, 1), "hello all", 0, None), (8, 2, 0, (1, 13, 2), "sup squad", 0, None),
        (9, 1, 1, (1, 12, 3), None, 2000, "p:0/g2"), (10, 2, 2, (1, 13, 3), None, 2003, "p:0/g8"),
    ]
    message = [(i, f"g{i}", t, None, h, _ns(*at), 0, None, int(h == 0), "iMessage", code, target, 0, 0, 0, None)
               for i, _c, h, at, t, code, target in rows]

    def table(name, data):
        return spark.createDataFrame(data, RAW[name])

    tables = {
        "handle": table("handle", [(1, "+15551234567", "iMessage"), (2, "+15559990000", "iMessage")]),
        "chat": table("chat", [(1, None, 45), (2, "the squad", 43), (3, None, 45)]),
        "chat_handle": table("chat_handle", [(1, 1), (2, 1), (2, 2), (3, 2)]),
        "message": table("message", message),
        "chat_message": table("chat_message", [(c, i) for i, c, *_ in rows]),
        "attachment": table("attachment", [(1, "image/png", 999)]),
        "message_attachment": table("message_attachment", [(2, 1)]),
        "contact": table("contact", [("a", 1, "Alice", "Smith", None), ("a", 2, "Bob", "Jones", None), ("b", 1, "Alicia", None, None)]),
        "contact_phone": table("contact_phone", [("a", 1, "+1 (555) 123-4567"), ("a", 2, "555-999-0000"), ("b", 1, "5551234567")]),
        "contact_email": table("contact_email", [("a", 1, "Alice@Example.com")]),
        "override_merge": table("override_merge", []), "override_rename": table("override_rename", []),
    }
    return {k: conform(v, RAW[k]) for k, v in tables.items()}


@pytest.fixture(scope="session")
def star(raw, tmp_path_factory):
    return ingest.publish_star(raw, str(tmp_path_factory.mktemp("star") / "s"))


@pytest.fixture(scope="session")
def flow(star):
    return ingest.message_flow(star["messages"]).cache()
