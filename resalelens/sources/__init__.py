"""Readers and writers: JSON envelopes, the month-partitioned Python data
source and stored month tables, history union, month generators and
projection specs."""
