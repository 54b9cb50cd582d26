"""The project's messages, bookings and ratings as threads, and the chat operators on them."""

from ridelattice.llm import chat, repair, threads

MESSAGES = "id string, booking_id string, sender_id string, recipient_id string, content string, is_automated int, created_at string, rating string"


def test_threads_of_the_projects_records(spark):
    m = spark.createDataFrame([
        ("m9", "b1", "u1", "d1", "Where are you?", 0, "10:02", "x"), ("m2", "b1", None, None, "Booking confirmed.", 1, "10:01", "x"), ("m5", "b1", "d1", "u1", "At the gate.", 0, "10:03", "x"),
        ("m1", "b2", "zz", None, None, None, None, "x"), ("m3", None, "u1", None, "Hi.", 0, "09:00", "x")], MESSAGES)
    b = spark.createDataFrame([("b1", "u1", "d1"), ("b1", "u1", "d1"), (None, "u1", "d1")], "booking_id string, rider_id string, driver_id string")
    r = spark.createDataFrame([("b1", 5), ("b1", 4), ("b7", 1)], "booking_id string, stars int")
    t = threads.booking_threads(m, b, r)
    got = {x["id"]: (x["turn"], x["reply_to"], x["sender_role"], x["rating"]) for x in t.collect()}
    assert got == {"m2": (1, None, "system", 4.5), "m9": (2, "m2", "user", 4.5), "m5": (3, "m9", "assistant", 4.5), "m1": (1, None, "other", None), "m3": (1, None, "other", None)}
    said = {x["booking_id"]: x for x in chat.format_threads(t).collect()}
    assert said["b1"]["formatted"].count(chat.SAYS) == 3 and said["b1"]["score"] == 13.5
    fixed = {x["booking_id"]: x["audit"] for x in repair.repaired_threads(t).collect()}
    assert fixed["b1"] == "KKK" and fixed["b2"] == "D"
    assert threads.booking_threads(m.limit(0), b, r).collect() == []
