"""adspark: ad-impression analytics on Spark DataFrames.

Every operator takes and returns DataFrames and is lazy. Sub-packages:

* ``functions``  column-level helpers (hashed uniforms, time features)
* ``sources``    table loaders, fixture views, Parquet/CSV sinks and layout
* ``operators``  labelling, cleaning, profiling, features, sampling,
                 candidate scoring, allocation, model scoring, metrics, policy
* ``plans``      end-to-end flows composed from operators
* ``streaming``  Structured Streaming versions of the operators
"""

from adspark.session import build_session, shared_path  # noqa: F401

__all__ = ["build_session", "shared_path"]
