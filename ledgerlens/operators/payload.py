"""Route and vehicle ids from the JSON key/value payload."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.config import ROUTE_KEY, VEHICLE_KEY
from ledgerlens.functions.json import json_array, max_value_for_key, plain_count, plain_pairs, plain_value


def with_payload_values(rows: DataFrame, only_when=None) -> DataFrame:
    """Per row: route and vehicle (max over the row's payload elements) and the
    number of elements (-1 without an array), in place of the payload text.

    The usual text, an array of plain pairs and nothing else, is recognised by one
    regular expression and read by others; the parsed array of any other is bound
    in a projection of its own. Expressions that are used several times and are
    not cheap stay there, so each payload is tested and parsed once.
    ``only_when`` (a boolean Column) limits both to the rows that need it; other
    rows get NULL values.
    """
    text = F.col("payload")
    plain = plain_pairs(text)
    tested = rows.withColumn("_plain", plain if only_when is None else F.when(only_when, plain))
    parsed = tested.withColumn("_array", F.when(~F.col("_plain"), json_array(text)))

    def value(key: str):
        return F.when(F.col("_plain"), plain_value(text, key)).otherwise(max_value_for_key(F.col("_array"), key))

    return parsed.withColumns({
        "row_route": value(ROUTE_KEY),
        "row_vehicle": value(VEHICLE_KEY),
        "payload_elements": F.when(F.col("_plain"), plain_count(text)).otherwise(F.coalesce(F.size("_array"), F.lit(-1))),
    }).drop("_plain", "_array", "payload")


def payload_route(rows: DataFrame) -> DataFrame:
    """A2: route per transaction = max over all its elements (tied rows
    included). A transaction without any element has no row (the unnest is an
    inner lateral join). ``rows`` must carry ``with_payload_values``."""
    return (rows.groupBy("transaction_id")
            .agg(F.max("row_route").alias("route"), F.max("payload_elements").alias("_elements"))
            .where(F.col("_elements") > 0)
            .drop("_elements"))


def with_transaction_route(rows: DataFrame) -> DataFrame:
    """Attach the transaction's route to each row (NULL if none): an
    aggregate, combined map-side, joined back."""
    return rows.join(payload_route(rows), "transaction_id", "left")


def payload_assets(rows: DataFrame) -> DataFrame:
    """Per (transaction, bucket, pre-invoice type): max route and max
    vehicle; a group exists only if its rows have at least one element."""
    # The element test is applied to the aggregate, not to the rows: a row
    # filter on a parsed column would be pushed below the projection and
    # parse the payload a second time.
    return (rows.groupBy("transaction_id", "bucket", "pre_invoice_type")
            .agg(F.max("row_route").alias("route"), F.max("row_vehicle").alias("vehicle"),
                 F.max("payload_elements").alias("_elements"))
            .where(F.col("_elements") > 0)
            .drop("_elements"))
