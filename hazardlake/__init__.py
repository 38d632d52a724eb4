"""hazardlake — time-to-event analytics written as Spark DataFrame plans.

Sub-packages:
  sources    scans, fixture views and sinks
  functions  column-expression helpers (text rules, lenient numerics)
  operators  aggregates, ordered prefix sums, splits, survival metrics,
             encoders, text vectors and model fits
  plans      end-to-end jobs built from the operators (training table,
             scoring job, registered queries and their SQL oracles)
"""

__version__ = "0.1.0"
