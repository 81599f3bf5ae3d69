"""What tests of several files use. Nothing is imported from a conftest: both folders have one."""

import time

AS_OF = "2024-03-15 12:00:00"


def by(df, *keys):
    """Collected rows as dicts, keyed by one column or several."""
    rows = [r.asDict() for r in df.collect()]
    out = {tuple(r[k] for k in keys) if len(keys) > 1 else r[keys[0]]: r for r in rows}
    assert len(out) == len(rows), "key is not unique"
    return out


def shuffle_files(spark):
    manager = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    files = manager.getAllFiles()
    return {name for i in range(files.size()) if (name := files.apply(i).getName()).startswith("shuffle_")}


def new_shuffle_files(spark, before):
    """Those not in ``before`` that stay; Spark deletes files in the background."""
    for _ in range(50):
        if not (left := shuffle_files(spark) - before):
            break
        time.sleep(0.1)
    return left
