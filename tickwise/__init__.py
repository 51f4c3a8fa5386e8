"""Temporal Datalog on Spark: rules compile to DataFrame plans, Catalyst runs them."""
