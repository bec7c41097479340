"""The Spark session that plans assume."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession

#: What results depend on: errors instead of nulls, times without zone, UTC.
SEMANTICS = {"spark.sql.ansi.enabled": "true", "spark.sql.session.timeZone": "UTC", "spark.sql.timestampType": "TIMESTAMP_NTZ", "spark.sql.caseSensitive": "false"}
#: How S3 variables of the environment map to Hadoop settings (fixed names).
S3 = {"S3_ENDPOINT": "fs.s3a.endpoint", "S3_ACCESS_KEY_ID": "fs.s3a.access.key", "S3_SECRET_ACCESS_KEY": "fs.s3a.secret.key"}


def s3_settings(env: dict[str, str] | None = None) -> dict[str, str]:
    """Hadoop settings for s3a paths; none without an endpoint. Keys are then required; SSL is off and the style is path unless set."""
    env = dict(os.environ) if env is None else env
    if not env.get("S3_ENDPOINT", "").strip():
        return {}
    for name in ("S3_ACCESS_KEY_ID", "S3_SECRET_ACCESS_KEY"):
        if not env.get(name, "").strip():
            raise ValueError(f"{name} is required when S3_ENDPOINT is set")
    ssl = env.get("S3_USE_SSL", "").strip().lower() in ("1", "t", "true")
    path_style = env.get("S3_URL_STYLE", "path").strip().lower() != "vhost"
    out = {f"spark.hadoop.{h}": env[n].strip() for n, h in S3.items()}
    return out | {"spark.hadoop.fs.s3a.connection.ssl.enabled": str(ssl).lower(), "spark.hadoop.fs.s3a.path.style.access": str(path_style).lower()}


def session(app: str = "millrace", **conf: str) -> SparkSession:
    """The running session, or a new one with adaptive execution on. Further settings as keywords with _ for a dot."""
    builder = SparkSession.builder.appName(app)
    settings = {"spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true", **SEMANTICS, **s3_settings(), **{k.replace("_", "."): v for k, v in conf.items()}}
    for k, v in settings.items():
        builder = builder.config(k, v)
    return builder.getOrCreate()


def spark_path(path: str) -> str:
    """A path as Spark reads it: s3:// becomes s3a://."""
    return "s3a://" + path[5:] if path.startswith("s3://") else path
