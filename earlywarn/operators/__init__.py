"""Table operators: hourly buckets, features, policy, evaluation, ward queries, operations, messages."""
