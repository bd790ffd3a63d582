"""The types of water of the basin's rivers, by attribute key."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Rivers by type of water, under their attribute keys.
WHITE = "amazonas, solimoes, madeira, purus, jurua, japura, caqueta, ica, putumayo, maranon, ucayali, napo, huallaga, mamore, beni, madre de dios, javari, yavari, branco, ji-parana, machado, pastaza, morona, santiago, tigre"
BLACK = "jutai, coari, tefe, negro, uatuma, nhamunda, urubu, preto da eva, manacapuru, jau, unini, cuieiras, demini, padauari, marauia, cauaburi, uaupes, vaupes, icana, xie, curicuriari, daraa, aracá, araca, cuiuni, piorini, badajos, mamia, purue, jauaperi, anaua, catrimani"
CLEAR = "tapajos, xingu, tocantins, araguaia, iriri, teles pires, juruena, aripuana, roosevelt, guapore, itenez, arinos, trombetas, mapuera, paru, maicuru, jari, curua-una, curua una, arapiuns, jamanxim, cristalino, fresco, bacaja, jamari, sucunduri, canuma, abacaxis, maues acu, maues-acu"


def water_types(spark: SparkSession) -> DataFrame:
    """key, type."""
    rows = [(key, kind) for kind, keys in (("white", WHITE), ("black", BLACK), ("clear", CLEAR)) for key in keys.split(", ")]
    return spark.createDataFrame(rows, "key string, type string")
