import json

from leafsight.sources import store
from leafsight.streaming import status


def write(folder, name, *events):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text("\n".join(json.dumps(dict(zip(("doc_id", "event", "at", "message", "chunks"), e))) for e in events))


def test_steps():
    assert [status.step(s, e) for s, e in (("", "queued"), ("queued", "started"), ("indexing", "finished"), ("indexing", "failed"), ("error", "finished"))] == ["queued", "indexing", "ready", "error", "ready"]
    assert [status.step(s, e) for s, e in (("ready", "progress"), ("", "finished"), ("ready", "failed"), ("indexing", "other"))] == [None] * 4


def test_good_bad_and_stuck_documents(spark, tmp_path):
    folder, registry, state = tmp_path / "events", str(tmp_path / "registry"), str(tmp_path / "state")

    def run():
        status.follow_events(spark, str(folder), registry, state, patience_s=600).awaitTermination()
        return {r["doc_id"]: (r["status"], r["message"], r["progress"], r["chunks"]) for r in store.load_registry(spark, registry).collect()}

    day = "2024-01-01T"
    # out of order within a file, repeated, and without an id
    write(folder, "1.json", ("good", "started", f"{day}10:01:00"), ("good", "queued", f"{day}10:00:00"), ("bad", "started", f"{day}10:00:00"), ("stuck", "started", f"{day}10:00:00"), ("stuck", "progress", f"{day}10:01:00", "page 3"), (None, "queued", f"{day}10:00:00"))
    got = run()
    assert got == {"good": ("indexing", "", "", None), "bad": ("indexing", "", "", None), "stuck": ("indexing", "", "page 3", None)}
    # the stream starts again from its checkpoint and knows where the documents were
    write(folder, "2.json", ("good", "finished", f"{day}10:05:00", None, 12), ("good", "progress", f"{day}10:05:30", "late"), ("bad", "failed", f"{day}10:05:00", "ValueError: no pages"))
    got = run()
    assert got["good"] == ("ready", "", "", 12) and got["bad"] == ("error", "ValueError: no pages", "", None) and got["stuck"][0] == "indexing"
    # another document's event moves time on, beyond the patience for the stuck one
    write(folder, "3.json", ("other", "queued", f"{day}10:40:00"))
    run()
    write(folder, "4.json", ("other", "started", f"{day}10:45:00"))
    got = run()
    assert got["stuck"][:2] == ("error", status.STUCK) and got["good"][0] == "ready" and got["other"][0] == "indexing"
    # it was alive after all
    write(folder, "5.json", ("stuck", "finished", f"{day}10:46:00", None, 3))
    got = run()
    assert got["stuck"] == ("ready", "", "", 3) and run() == got
