"""Retail behaviour analytics as PySpark jobs.

``functions``  column expressions, usable on batch and streaming frames
``operators``  DataFrame -> DataFrame building blocks
``sources``    readers and writers
``plans``      end-to-end jobs composed from the above
``streaming``  Structured Streaming drivers and stateful processors
``reports``    the registered queries with their SQL checks
"""
