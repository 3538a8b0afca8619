"""Column-level functions: conversion, JSON, canonical names, dates, privacy."""
