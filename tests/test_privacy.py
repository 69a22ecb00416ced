"""Access reports with whole, bounded records."""

import datetime as dt

from pyspark.sql import functions as F

from tillwise.operators import privacy

T0 = dt.datetime(2024, 1, 1)


def test_sections_are_bounded_newest_first_and_counted(spark, monkeypatch):
    monkeypatch.setattr(privacy, "LIMITS", {**privacy.LIMITS, "consent_records": 2, "data_sources": 3})
    subject = "subject_id long, external_id string, email string, phone string, name string, is_active boolean, consent_given boolean, consent_date date, deletion_requested boolean, deletion_scheduled date, data_sources string, processing_purposes string, legal_basis string"
    subjects = spark.createDataFrame([(1, "x", "a@b.org", None, "A", True, True, None, False, None, "crm", "orders", "CONSENT"), (2, *[None] * 12)], subject)
    fields = "subject_id long, event_id long, ts timestamp, kind string, purpose string, legal_basis string, system string, processor string, data_categories string, is_compliant boolean, recipients string, automated boolean, logic string, significance string, consequences string"
    kinds = ["STORAGE", "TRANSMISSION", "ANALYSIS"]
    activity = spark.createDataFrame([(1, i, T0 + dt.timedelta(hours=i), kinds[i % 3], f"p{i}", None, "s", None, "c", True, f"r{i}", i % 2 == 0, None, "high", None) for i in range(150)], fields)
    consent = "subject_id long, consent_id long, purpose string, legal_basis string, is_active boolean, given timestamp, withdrawn timestamp, expiry timestamp, source string, version string"
    consents = spark.createDataFrame([(1, i, f"p{i}", "CONSENT", True, T0 + dt.timedelta(days=i), None, None, None, "v1") for i in range(5)], consent)
    place = "subject_id long, location string, pii_type string, category string, sensitivity string, is_encrypted boolean, is_tokenized boolean, record_count long, last_verified timestamp"
    places = spark.createDataFrame([(1, f"db.{i}", "email", "c", "HIGH", True, False, i, None) for i in range(9)], place)
    policies = spark.createDataFrame([("keep", "c", 30, "DELETE", True), ("old", "c", 900, "DELETE", False)], "name string, category string, retention_days int, action string, is_active boolean")
    rows = {r.subject_id: r for r in privacy.access_report(subjects, activity, consents, places, policies, F.to_date(F.lit("2024-02-01"))).collect()}
    one, two = rows[1], rows[2]
    assert one.personal_data.basic_information.email == "a@b.org" and one.personal_data.account_status.is_active
    assert [r.purpose for r in one.processing_activities] == [f"p{i}" for i in range(149, 49, -1)]
    assert [r.recipients for r in one.sharing_information][:2] == ["r148", "r145"] and len(one.sharing_information) == 50
    assert len(one.automated_processing) == 20 and one.automated_processing[0].logic == "Not specified" and one.automated_processing[0].significance == "high"
    assert [r.purpose for r in one.consent_records] == ["p4", "p3"] and one.consent_count == 5
    assert [r.location for r in one.data_sources] == ["db.0", "db.1", "db.2"] and one.place_count == 9
    assert [p.name for p in one.retention_information.policies] == ["keep"] and str(one.retention_information.estimated_deletion_date) == "2024-03-02"
    assert two.processing_activities == [] and two.consent_count == 0 and two.retention_information.estimated_deletion_date is None
