"""Precomputed grid datasets: nested JSON in, flat tables in and out, region headers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

_CORNER = T.ArrayType(T.ArrayType(T.DoubleType()))
_CELL = T.StructType(
    [T.StructField(n, T.DoubleType()) for n in ("lat", "lng")]
    + [T.StructField("bounds", _CORNER), T.StructField("label", T.StringType())]
    + [T.StructField(n, T.IntegerType()) for n in ("labelCode", "originalScore", "originalFit")]
    + [T.StructField(n, T.DoubleType()) for n in ("highEvidence", "lowEvidence", "ordinaryEvidence")]
    + [
        T.StructField(n, T.IntegerType())
        for n in ("auxiliaryTerrainScore", "detailScore", "neighborhoodScore", "confidence", "nearbyBestIndex",
                  "nearbyBestDistanceMeters")
    ]
)
_HOTSPOT = T.StructType(
    [T.StructField(n, T.DoubleType()) for n in ("lat", "lng")]
    + [T.StructField(n, T.IntegerType()) for n in ("detailScore", "originalScore", "confidence")]
    + [T.StructField(n, T.StringType()) for n in ("label", "nearestStation")]
    + [T.StructField("stationDistanceMeters", T.IntegerType())]
)
_PLACE = [
    T.StructField("stepMeters", T.DoubleType()),
    T.StructField("radiusMeters", T.DoubleType()),
    T.StructField("bufferMeters", T.DoubleType()),
]
GRID_SCHEMA = T.StructType(
    [
        T.StructField("generatedAt", T.StringType()),
        T.StructField(
            "center",
            T.StructType(
                [T.StructField("lat", T.DoubleType()), T.StructField("lng", T.DoubleType()),
                 T.StructField("name", T.StringType()), T.StructField("address", T.StringType()), *_PLACE]
            ),
        ),
        T.StructField(
            "region",
            T.StructType([T.StructField(n, T.StringType()) for n in ("id", "kind", "name")] + _PLACE),
        ),
        T.StructField("bounds", _CORNER),
        T.StructField("cells", T.ArrayType(_CELL)),
        T.StructField("hotspots", T.ArrayType(_HOTSPOT)),
    ]
)

#: Nested JSON names and the flat column names used everywhere else.
CELL_NAMES = (
    ("lat", "lat"), ("lng", "lng"), ("label", "label"), ("labelCode", "label_code"),
    ("originalScore", "original_score"), ("originalFit", "original_fit"), ("highEvidence", "high_evidence"),
    ("lowEvidence", "low_evidence"), ("ordinaryEvidence", "ordinary_evidence"),
    ("auxiliaryTerrainScore", "auxiliary_score"), ("detailScore", "detail_score"),
    ("neighborhoodScore", "neighborhood_score"), ("confidence", "confidence"),
    ("nearbyBestIndex", "nearby_best_index"), ("nearbyBestDistanceMeters", "nearby_best_distance"),
)
HOTSPOT_NAMES = (
    ("lat", "lat"), ("lng", "lng"), ("detailScore", "detail_score"), ("originalScore", "original_score"),
    ("confidence", "confidence"), ("label", "label"), ("nearestStation", "nearest_station"),
    ("stationDistanceMeters", "station_distance"),
)


def _corner(bounds, i: int, j: int):
    return F.get(F.get(bounds, F.lit(i)), F.lit(j))


def read_grids(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """One row per grid document, plus ``region_id`` and ``document``; a document that is not valid JSON fails the read.

    ``document`` orders the documents: by the given paths, and by file name within one.
    """
    paths = [path] if isinstance(path, str) else path
    docs = None
    for i, one in enumerate(paths):
        part = spark.read.schema(GRID_SCHEMA).json(one, multiLine=True, mode="FAILFAST")
        part = part.withColumn("document", F.struct(F.lit(i).alias("path"), F.input_file_name().alias("file")))
        docs = part if docs is None else docs.union(part)
    return docs.withColumn("region_id", F.coalesce("region.id", "center.name"))


def grid_cells(docs: DataFrame) -> DataFrame:
    """Flat cells with their bounds as four columns and their position in the document."""
    rows = docs.select("region_id", F.posexplode("cells").alias("cell_index", "c"))
    return rows.select(
        "region_id",
        "cell_index",
        *[F.col(f"c.{old}").alias(new) for old, new in CELL_NAMES],
        _corner(F.col("c.bounds"), 0, 0).alias("south"),
        _corner(F.col("c.bounds"), 0, 1).alias("west"),
        _corner(F.col("c.bounds"), 1, 0).alias("north"),
        _corner(F.col("c.bounds"), 1, 1).alias("east"),
    )


def grid_hotspots(docs: DataFrame) -> DataFrame:
    rows = docs.select("region_id", F.posexplode("hotspots").alias("hotspot_index", "h"))
    return rows.select("region_id", "hotspot_index", *[F.col(f"h.{old}").alias(new) for old, new in HOTSPOT_NAMES])


def grid_regions(docs: DataFrame) -> DataFrame:
    """Region header: id, order of the documents, name, centre, extent, step. There is one per document, so few."""
    return docs.select(
        "region_id",
        (F.dense_rank().over(Window.orderBy("document")) - 1).alias("region_order"),
        F.coalesce("region.name", "center.name").alias("region_name"),
        F.col("center.lat").alias("center_lat"),
        F.col("center.lng").alias("center_lng"),
        F.col("center.stepMeters").alias("step_m"),
        F.coalesce("center.radiusMeters", F.lit(4500.0)).alias("radius_m"),
        _corner(F.col("bounds"), 0, 0).alias("south"),
        _corner(F.col("bounds"), 0, 1).alias("west"),
        _corner(F.col("bounds"), 1, 0).alias("north"),
        _corner(F.col("bounds"), 1, 1).alias("east"),
        F.col("generatedAt").alias("generated_at"),
    )


def region_meta(cells: DataFrame, regions: DataFrame) -> DataFrame:
    """Region headers with their number of cells (0 for a region without cells)."""
    counts = cells.groupBy("region_id").agg(F.count(F.lit(1)).alias("cell_count"))
    return regions.join(counts, "region_id", "left").fillna(0, ["cell_count"])


def write_cells(df: DataFrame, path: str, *, engine: dict[str, str] | None = None, fmt: str = "parquet") -> None:
    """Write cells by region; engine metadata travels as constant columns so any file explains itself."""
    for name, value in (engine or {}).items():
        df = df.withColumn(f"engine_{name}", F.lit(value))
    df.write.mode("overwrite").partitionBy("region_id").format(fmt).save(path)


def read_cells(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """A dataset of :func:`write_cells`; the region's id comes back as text, whatever it looks like."""
    return spark.read.format(fmt).load(path).withColumn("region_id", F.col("region_id").cast("string"))


def read_boundary_features(spark: SparkSession, path: str) -> DataFrame:
    """GeoJSON feature collection to (feature_id, admin_code, polygon_id, ring_id, seq, lng, lat) vertices.

    Coordinates are read as text first because Polygon and MultiPolygon nest differently.
    """
    feature = T.StructType(
        [
            T.StructField("properties", T.MapType(T.StringType(), T.StringType())),
            T.StructField(
                "geometry",
                T.StructType([T.StructField("type", T.StringType()), T.StructField("coordinates", T.StringType())]),
            ),
        ]
    )
    docs = spark.read.schema(T.StructType([T.StructField("features", T.ArrayType(feature))])).json(
        path, multiLine=True
    )
    return docs.select(F.posexplode("features").alias("feature_id", "f")).select(
        "feature_id",
        F.element_at("f.properties", "N03_007").alias("admin_code"),
        F.col("f.geometry.type").alias("kind"),
        F.col("f.geometry.coordinates").alias("coordinates"),
    )


def boundary_vertices(features: DataFrame) -> DataFrame:
    """Feature rows to one row per ring vertex; other geometry kinds contribute nothing."""
    polygon = T.ArrayType(T.ArrayType(T.ArrayType(T.DoubleType())))
    multi = T.ArrayType(polygon)
    parts = F.when(F.col("kind") == "Polygon", F.array(F.from_json("coordinates", polygon))).when(
        F.col("kind") == "MultiPolygon", F.from_json("coordinates", multi)
    )
    return (
        features.select("feature_id", "admin_code", F.posexplode(parts).alias("part", "rings"))
        .select("feature_id", "admin_code", "part", F.posexplode("rings").alias("ring_id", "ring"))
        .select("feature_id", "admin_code", "part", "ring_id", F.posexplode("ring").alias("seq", "v"))
        .select(
            F.concat_ws("/", "feature_id", "part").alias("polygon_id"),
            "admin_code",
            "ring_id",
            "seq",
            F.get("v", F.lit(0)).alias("lng"),
            F.get("v", F.lit(1)).alias("lat"),
        )
    )


#: Administrative codes of the supported wards.
SUPPORTED_CODES = tuple(str(c) for c in [*range(13101, 13124), *range(14101, 14119), *range(14131, 14138)])


def filter_boundaries(features: DataFrame, codes: tuple[str, ...] = SUPPORTED_CODES) -> DataFrame:
    return features.filter(F.col("admin_code").isin(*codes))
