"""Scalar expressions: plain functions from Column to Column, no UDFs."""
