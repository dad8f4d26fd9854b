"""Registered queries and, beside each, the SQL an independent engine checks it with."""
