from pyspark.sql import functions as F


def clash(df):
    """Extra columns whose names the operators use inside."""
    return df.select("*", *[F.lit("c").alias(c) for c in ("fp", "th", "digest", "n_tokens", "block", "kept", "t", "x", "base",
                                                          "leaf", "line", "score", "copies", "host", "w", "e", "id", "key")])
