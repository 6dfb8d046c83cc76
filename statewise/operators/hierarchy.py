"""Element -> parcel -> network levels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def mean_of_means(signal: DataFrame) -> DataFrame:
    """Mean of parcel means by network (not pooled over elements)."""
    parcels = signal.groupBy("subject", "network", "parcel", "t").agg(F.avg("value").alias("value"))
    return parcels.groupBy("subject", "network", "t").agg(F.avg("value").alias("value"), F.count("*").alias("n_parcels"))


def network_lookup(parcels: DataFrame, atlas: DataFrame) -> DataFrame:
    """Parcels with data and their network."""
    return parcels.join(atlas, "parcel")


def networks_missing(parcels: DataFrame, atlas: DataFrame) -> DataFrame:
    """Networks of which no parcel has data."""
    return atlas.select("network").distinct().join(network_lookup(parcels.select("parcel").distinct(), atlas).select("network"), "network", "left_anti")


def value_to_elements(values: DataFrame, atlas: DataFrame) -> DataFrame:
    """A network's value on each of its elements."""
    return atlas.join(values, "network")
