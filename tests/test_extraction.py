"""Organisations and actors in two languages."""

import pytest
from pyspark.sql import functions as F

from casebook.operators import extract

CASES = [
    ("en", "Acme Bank confirms data breach", "Acme Bank"), ("en", "Ransomware attack on North Clinic halts surgeries", "North Clinic"), ("en", "Hackers hit Delta Air", "Delta Air"), ("en", "Researchers said nothing", None),
    ("id", "Bank Jaya Dibobol Hacker, Saldo Nasabah Raib", "Bank Jaya"), ("id", "Situs diretas semalam", None), ("id", "Hacker Diduga Jebol Server Telko Nusantara", "Telko Nusantara"),
    ("id", "Kebocoran data pelanggan di Toko Makmur terungkap", "Toko Makmur"), ("id", "Peretasan Kapal Air rugikan ribuan orang", "Kapal Air"), ("id", "Universitas Bahari akui data mahasiswa bocor", "Universitas Bahari"),
    ("id", "Polda Jatim ungkap kasus peretasan", None), ("id", "Koin Protokol pulih usai serangan phishing", "Koin Protokol"), ("id", "cuaca hari ini cerah", None), ("id", None, None),
]


def test_organisations(spark):
    df = spark.createDataFrame([(i, lang, text) for i, (lang, text, _) in enumerate(CASES)], "id int, lang string, text string")
    found = {r["id"]: r["o"] for r in df.select("id", extract.organisation(F.col("text"), F.col("lang")).alias("o")).collect()}
    assert [found[i] for i in range(len(CASES))] == [want for _, _, want in CASES]


@pytest.mark.parametrize(("text", "want"), [
    ("LockBit and LockBit Black, says police", "LockBit, LockBit Black"), ("It was claimed by Night Fox, then by NIGHT FOX", "Night Fox"), ("kelompok peretas bernama Gajah Hitam menyerang", "Gajah Hitam"),
    ("peretas yang mengaku sebagai DigitalHantu", "DigitalHantu"), ("Bjor mengaku bertanggung jawab, bersama LockBit", "LockBit, Bjor"), ("nobody knows", None), (None, None), ("Lockbitten", None)])
def test_actors(spark, text, want):
    df = spark.createDataFrame([(1, text)], "id long, text string")
    assert extract.actors(df, ["LockBit", "LockBit Black"]).first()["actors"] == want
