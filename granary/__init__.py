"""Granary: retailer-catalogue analytics and corpus preparation as Spark DataFrame jobs."""
