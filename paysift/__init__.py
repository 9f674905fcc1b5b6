"""paysift — transaction-risk analytics as Spark DataFrame operators.

Every operator is a ``DataFrame -> DataFrame`` transformation planned by
Catalyst.  Sub-packages:

* ``sources``   — schemas, the transactions view, file sources and sinks
* ``functions`` — column-level helpers (guarded division, hash randomness,
                  guarded correlation) and the exact distributed quantile
* ``operators`` — profiles, features, sampling, metrics, perturbations, models
* ``plans``     — composed pipelines (feature matrix, robustness scenarios)
                  and the two-level prefix-sum helper
* ``streaming`` — the row-wise feature groups on a streaming DataFrame
"""

__version__ = "0.1.0"
