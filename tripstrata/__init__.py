"""Spark-native segmentation analytics: coupon -> booking -> customer, rules, drift and clustering."""
