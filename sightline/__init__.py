"""Spatial asset analytics on Spark: detections, devices, clouds and maintenance as DataFrame operators."""
