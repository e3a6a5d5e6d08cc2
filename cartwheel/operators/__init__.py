"""Report families, each a set of DataFrame -> DataFrame functions.

traffic     sessions only: sources, weekly/monthly volume, channels, staffing grid
conversion  sessions with orders: conversion, revenue per segment and period
landing     first views, landing pages, bounce rates, landing-page tests
billing     billing-page test: conversion and revenue per page
funnel      funnel flags per session, step counts and click rates
paths       next page after a page, cart follow-through, product click-through
products    sales trend, margins, refunds, cross-sell
repeat      repeat visitors
"""
