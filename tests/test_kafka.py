"""The Kafka jar is not installed here: the options are checked, the streams run on files elsewhere."""

import pytest

from matchpulse.sources import kafka

SASL = kafka.Security("SASL_SSL", "SCRAM-SHA-256", "user", "word")


def test_a_start_at_the_beginning_needs_a_limit():
    with pytest.raises(ValueError):
        kafka.reader_options(kafka.Topic("b:9092", "t", "earliest"))
    assert "maxOffsetsPerTrigger" not in kafka.reader_options(kafka.Topic("b:9092", "t"))


def test_replay_does_not_lose_offsets():
    options = kafka.replay_options(kafka.Topic("b:9092", "t", "earliest", "g", 5000, SASL))
    assert options["failOnDataLoss"] == "true" and options["startingOffsets"] == "earliest"
    assert "maxOffsetsPerTrigger" not in options and options["kafka.security.protocol"] == "SASL_SSL"


def test_plain_connections_need_no_options():
    assert kafka.kafka_security_options(kafka.Security()) == {}
    assert kafka.kafka_security_options(kafka.Security(mechanism="")) == {}


def test_reader_and_writer_share_the_security():
    topic = kafka.Topic("b:9092", "t", "earliest", "g", 5000, SASL)
    reader, writer = kafka.reader_options(topic), kafka.writer_options(topic)
    assert reader["subscribe"] == writer["topic"] == "t"
    assert reader["startingOffsets"] == "earliest" and reader["failOnDataLoss"] == "false"
    assert reader["kafka.group.id"] == "g" and reader["maxOffsetsPerTrigger"] == "5000"
    for options in (reader, writer):
        assert options["kafka.security.protocol"] == "SASL_SSL"
        assert options["kafka.sasl.mechanism"] == "SCRAM-SHA-256"
        assert 'username="user" password="word";' in options["kafka.sasl.jaas.config"]


def test_defaults():
    reader = kafka.reader_options(kafka.Topic("b:9092", "t"))
    assert reader["startingOffsets"] == "latest" and "kafka.group.id" not in reader


def test_secrets_come_from_the_environment(monkeypatch):
    monkeypatch.setenv("KAFKA_SASL_MECHANISM", "PLAIN")
    monkeypatch.setenv("KAFKA_SASL_PASSWORD", "hidden")
    security = kafka.Security.from_env()
    assert security.mechanism == "PLAIN" and "hidden" not in repr(security)
