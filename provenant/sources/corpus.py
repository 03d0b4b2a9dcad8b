"""The JSON catalogue of contacts, calls, messages, recordings, presets and e-mail identities."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CONTACT = "publicId string, phone string, label string, backupName string, interactions bigint"
CALL = "id string, phone string, contact string, t string, duration bigint, type string"
MESSAGE = "id string, phone string, contact string, sender string, t string, body string"
RECORDING = "id string, phone string, file string, t string, duration bigint"
PRESET = "id string, label string, phones array<string>, senders array<string>, keywords array<string>, domains array<string>"
EMAIL = "email string, label string, `group` string"
PARTS = ("contacts", "calls", "sms", "mms", "recordings", "presets", "emailIdentities")


def read_corpus_seed(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """One DataFrame a part; fields the schema doesn't name are ignored. A catalogue without contacts is refused."""
    whole = spark.read.schema(_schema()).option("multiLine", True).json(path)
    if whole.filter(F.coalesce(F.size("contacts"), F.lit(0)) > 0).limit(1).count() == 0:
        raise ValueError("the catalogue has no contacts")
    parts = {name: whole.select(F.explode(name).alias("x")).select("x.*") for name in PARTS}
    return parts | {"defaults": whole.select("defaultPresetIds", F.transform("presets", lambda p: p["id"]).alias("available"))}


def _schema() -> str:
    part = lambda fields: "array<struct<" + ", ".join(f"{name}:{kind}" for name, kind in (f.rsplit(" ", 1) for f in fields.split(", "))) + ">>"
    kinds = {"contacts": CONTACT, "calls": CALL, "sms": MESSAGE, "mms": MESSAGE, "recordings": RECORDING, "presets": PRESET, "emailIdentities": EMAIL}
    return ", ".join(f"{name} {part(fields)}" for name, fields in kinds.items()) + ", defaultPresetIds array<string>"
