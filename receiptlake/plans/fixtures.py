"""Receipt words, feedback and pixels derived from the given tables.

Each derivation is one text in SQL that Spark and DuckDB both read: {div} is
the engine's integer division, and the tables are named in braces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.io import scratch  # noqa: F401

#: slot, text if it is the same everywhere, left, top, width
LAYOUT = [
    (0, "PAGO", 100, 40, 60), (1, "MOVIL", 170, 40, 70), (2, "Transferencia", 260, 40, 140), (3, "Monto", 100, 160, 70), (4, None, 180, 160, 120), (5, "Bs", 310, 160, 25),
    (6, "Fecha:", 100, 200, 70), (7, None, 180, 200, 110), (8, "Referencia", 100, 320, 110), (9, None, 220, 320, 140), (10, "C.I.", 100, 360, 40), (11, None, 150, 360, 110),
    (12, "Origen:", 100, 400, 80), (13, None, 190, 400, 120), (14, "Banco:", 100, 440, 70), (15, "MERCANTIL", 180, 440, 100), (16, "Concepto:", 100, 480, 90), (17, None, 200, 480, 90),
    (18, "Destino:", 420, 400, 80), (19, None, 510, 400, 120), (20, "BLOQUE", 80, 150, 640),
]

_ROWS = ", ".join(f"({s}, {'NULL' if t is None else repr(t)}, {x}, {y}, {w})" for s, t, x, y, w in LAYOUT)

WORDS = f"""
SELECT {{image}} AS image_id,
  CAST(slot - (CASE WHEN k % 5 = 0 THEN least(slot, 3) + (CASE WHEN slot > 10 THEN 1 ELSE 0 END) ELSE 0 END)
    - (CASE WHEN k % 11 = 0 AND slot > 3 THEN 1 ELSE 0 END) AS INT) AS word_idx,
  CASE WHEN fixed IS NOT NULL THEN fixed
    WHEN slot = 4 THEN CASE
      WHEN k % 3 = 2 AND cents >= 100000 THEN concat(CAST(cents {{div}} 100000 AS STRING), '.', lpad(CAST((cents {{div}} 100) % 1000 AS STRING), 3, '0'), ',', lpad(CAST(cents % 100 AS STRING), 2, '0'))
      ELSE concat(CAST(cents {{div}} 100 AS STRING), CASE WHEN k % 3 = 1 THEN '.' ELSE ',' END, lpad(CAST(cents % 100 AS STRING), 2, '0')) END
    WHEN slot = 7 THEN concat(lpad(CAST(day(d) AS STRING), 2, '0'), '/', lpad(CAST(month(d) AS STRING), 2, '0'), '/', CAST(year(d) AS STRING))
    WHEN slot = 9 THEN lpad(CAST(k AS STRING), 12, '0')
    WHEN slot = 11 THEN concat('V-', lpad(CAST(c AS STRING), 8, '0'))
    WHEN slot = 13 THEN lpad(CAST(c * 7 AS STRING), 11, '0')
    WHEN slot = 19 THEN lpad(CAST(c * 3 AS STRING), 11, '0')
    ELSE priority END AS text,
  CAST(left0 + k % 7 AS INT) AS "left", CAST(top0 + k % 5 AS INT) AS top, CAST(width0 AS INT) AS width, CAST(CASE WHEN slot = 20 THEN 120 ELSE 20 END AS INT) AS height,
  CAST(40 + (k * 31 + slot * 17) % 60 AS DOUBLE) AS conf
FROM (SELECT {{also}}o_orderkey AS k, o_custkey AS c, CAST(round(o_totalprice * 100) AS BIGINT) AS cents, CAST(o_orderdate AS DATE) AS d, o_orderpriority AS priority FROM {{orders}}) o
CROSS JOIN (SELECT * FROM (VALUES {_ROWS}) AS v(slot, fixed, left0, top0, width0)) s
WHERE NOT (k % 5 = 0 AND slot IN (0, 1, 2, 10)) AND NOT (k % 11 = 0 AND slot = 3) AND NOT (slot = 20 AND k % 7 <> 0)
"""

FEEDBACK = """
SELECT concat('img-', CAST(user_id AS STRING)) AS id_unico_imagen,
  CASE event_id % 8 WHEN 0 THEN 'monto' WHEN 1 THEN 'fecha' WHEN 2 THEN 'operacion' WHEN 3 THEN 'identificacion' WHEN 4 THEN 'origen_numero'
    WHEN 5 THEN 'destino_numero' WHEN 6 THEN 'banco_completo' ELSE 'concepto' END AS campo_nombre,
  CASE WHEN event_type = 'purchase' THEN '' ELSE concat('raw_', CAST(event_id % 97 AS STRING)) END AS raw_ocr_output,
  concat('val_', CAST(event_id % 3 AS STRING)) AS valor_corregido,
  CASE event_type WHEN 'error' THEN 'caracter_mal_reconocido' WHEN 'click' THEN 'mala_segmentacion' WHEN 'purchase' THEN 'campo_no_detectado'
    WHEN 'signup' THEN 'otro' ELSE 'causa_desconocida' END AS causa_raiz,
  CAST(ts AS TIMESTAMP) AS timestamp_feedback, event_id AS seq
FROM {events}
"""

PIXELS = """
SELECT concat('pix-', CAST(vec_id AS STRING)) AS image_id, CAST(400 + (vec_id * 37) % 900 AS INT) AS img_width, CAST(300 + (vec_id * 53) % 800 AS INT) AS img_height,
  CASE abs(label) % 4 WHEN 0 THEN 0.4 WHEN 1 THEN 0.65 WHEN 2 THEN 0.69 ELSE 1.3 END AS f, embedding
FROM {embeddings} WHERE embedding IS NOT NULL
"""


#: A receipt's image, by its order.
IMAGE = "concat('img-', CAST(k AS STRING))"


def _spark(text: str) -> str:
    return text.replace("{div}", "div").replace('"left"', "`left`").replace("{image}", "image_id").replace("{also}", "image_id, ")


def oracle(text: str, **tables: str) -> str:
    """The derivation for DuckDB."""
    out = text.replace("{div}", "//").replace("{image}", IMAGE).replace("{also}", "")
    for name in ("orders", "events", "embeddings"):
        out = out.replace("{" + name + "}", name)
    return out


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """OCR words, 21 at most from an order. The narrow orders are dealt out by image before, so that
    all that is joined or grouped by image afterwards finds its rows in place."""
    orders = read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderdate", "o_orderpriority", F.concat(F.lit("img-"), F.col("o_orderkey").cast("string")).alias("image_id"))
    return spark.sql(_spark(WORDS), orders=orders.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "image_id"))


def images(words_: DataFrame) -> DataFrame:
    """Image sizes and the full text, from the words."""
    listed = F.sort_array(F.collect_list(F.struct("word_idx", "text")))
    return words_.groupBy("image_id").agg(F.array_join(listed["text"], " ").alias("full_text")).select("image_id", F.lit(800).alias("img_width"), F.lit(600).alias("img_height"), "full_text")


def feedback(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(_spark(FEEDBACK), events=read(spark, sf_dir, "events"))


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """8 x 8 gray values from the embeddings, with image sizes beside."""
    p = spark.sql(_spark(PIXELS), embeddings=read(spark, sf_dir, "embeddings"))
    gray = F.transform("embedding", lambda x: F.greatest(F.lit(0), F.least(F.lit(255), F.floor((x.cast("double") + 1) * 127.5 * F.col("f")).cast("int"))))
    return p.select("image_id", "img_width", "img_height", F.lit(8).alias("width"), F.lit(8).alias("height"), gray.alias("gray"))


WORDS_ORACLE = f"WITH words AS ({oracle(WORDS)}), images AS (SELECT image_id, 800 AS img_width, 600 AS img_height, string_agg(text, ' ' ORDER BY word_idx) AS full_text FROM words GROUP BY image_id)"
FEEDBACK_ORACLE = f"WITH feedback AS ({oracle(FEEDBACK)})"
PIXELS_ORACLE = f"""WITH pixels AS (SELECT image_id, img_width, img_height, list_transform(embedding, lambda x: greatest(0, least(255, CAST(floor((CAST(x AS DOUBLE) + 1) * 127.5 * CAST(f AS DOUBLE)) AS INT)))) AS gray FROM ({oracle(PIXELS)}))"""
