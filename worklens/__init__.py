"""worklens: workforce activity analytics as Spark DataFrame jobs.

* ``worklens.sources`` - table schemas, the ``Tables`` bundle, reader and
  versioned writer, fixture tables derived from synthetic parquet.
* ``worklens.functions`` - column expressions (clock text, name matching,
  site names, calendar).
* ``worklens.operators`` - the jobs, each ``DataFrame(s) -> DataFrame``.
* ``worklens.plans`` - the composed re-attribution job and distributed
  building blocks (spreading of hot and NULL keys, lineage cut, global ordinal).

``python -m worklens <job> --tables <root> --out <path>`` runs one job.
"""
