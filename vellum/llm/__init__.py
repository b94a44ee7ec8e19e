"""Training-data operators: tokenisation, language ID, quality, near-duplicate
detection, secret scans, source mixing and web-archive joins.

Nothing else in the library imports this subpackage.  ``QUERIES`` and
``ORACLE`` (see :mod:`.queries`) hold what the driver entry registers.
"""
