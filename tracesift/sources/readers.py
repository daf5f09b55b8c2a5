"""Text and labelled-example sources."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracesift.plans.corpus import EXAMPLE
from tracesift.sources.text_ranges import SPLIT_BYTES, read_ranges

#: Bytes of a piece of a file: little enough that most pieces hold nothing that any rule needs to look at.
PIECE_BYTES = 8 << 10


def read_text_lines(spark: SparkSession, path: str, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """Text files by line (``file``, ``offset``, ``text``): a huge file becomes many tasks.

    ``offset`` is the byte of the file at which the line starts, so equal lines stay apart, and a finding's place in the
    file is that plus its place in the line.  No finding spans a line break: scanning lines finds what scanning
    whole files does.  A line ends with a line feed; a carriage return before it stays in the text.
    """
    return read_ranges(spark, path, split_bytes=split_bytes)


def read_text_pieces(spark: SparkSession, path: str, piece_bytes: int = PIECE_BYTES, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """Text files in pieces of about so many bytes, whatever their lines, as ``operators.pieces.scan_pieces`` takes them."""
    return read_ranges(spark, path, split_bytes=split_bytes, piece_bytes=piece_bytes)


def read_whole_texts(spark: SparkSession, path: str) -> DataFrame:
    """Text files whole (``file``, ``text``), for offsets within the file."""
    return _checked(spark.read.text(path, wholetext=True))


def _checked(df: DataFrame) -> DataFrame:
    """Invalid UTF-8 fails the job; offsets would be wrong otherwise."""
    return df.select(F.col("_metadata.file_path").alias("file"), F.validate_utf8("value").alias("text"))


def read_examples(spark: SparkSession, path: str) -> DataFrame:
    """Labelled examples as JSON lines.  Blank lines are skipped; a malformed
    line, or one without ``text`` or ``expected``, or with a label without
    ``kind`` or ``value``, fails the job and names the file."""
    examples = spark.read.schema(EXAMPLE).option("mode", "FAILFAST").json(path)

    def required(name):
        message = F.concat(F.lit(f"example without {name} in "), F.col("_metadata.file_path"))
        return F.coalesce(usable(name), F.raise_error(message).cast(examples.schema[name].dataType)).alias(name)

    def usable(name):
        if name == "text":
            return F.col(name)
        whole = F.forall(name, lambda x: x["kind"].isNotNull() & x["value"].isNotNull())
        message = F.concat(F.lit("label without kind or value in "), F.col("_metadata.file_path"))
        return F.when(F.col(name).isNull() | whole, F.col(name)).otherwise(F.raise_error(message).cast(examples.schema[name].dataType))

    return examples.select(required("text"), required("expected"))
