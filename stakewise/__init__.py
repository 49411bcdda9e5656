"""Decision analytics on Spark: spend-or-wait rules for a scarce, replenishable resource."""
