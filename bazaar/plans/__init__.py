"""Registered query plans (operator + role views + parameters) and their SQL oracle twins."""
